"""Tables, views, indexes and constraints by tenant, kept in the tenant's commit log beside the data."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions import types as kinds
from granary.operators import statistics
from granary.sources.log import TenantLog
from granary.sources.tables import ConflictError, ManagedTable


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: str
    nullable: bool = True
    primary_key: bool = False
    unique: bool = False
    default: Any = None

    def field(self) -> T.StructField:
        return T.StructField(self.name, kinds.spark_type(self.type), True)


@dataclass(frozen=True)
class IndexDef:
    name: str
    table: str
    columns: tuple[str, ...]
    unique: bool = False
    method: str = "btree"
    where: str | None = None


@dataclass(frozen=True)
class ConstraintDef:
    """kind: primary_key, unique, foreign_key, check or not_null."""

    name: str
    kind: str
    columns: tuple[str, ...] = ()
    check: str | None = None
    references: tuple[str, ...] = ()  # table, then its columns


@dataclass(frozen=True)
class TableDef:
    name: str
    columns: tuple[ColumnDef, ...]
    constraints: tuple[ConstraintDef, ...] = ()
    version: int = 1

    def schema(self) -> T.StructType:
        return T.StructType([*(c.field() for c in self.columns), T.StructField(ROWID, T.LongType(), True)])

    def column(self, name: str) -> ColumnDef:
        for c in self.columns:
            if c.name == name:
                return c
        raise KeyError(f"no column {name} in {self.name}")


@dataclass(frozen=True)
class ViewDef:
    name: str
    query: str


@dataclass
class Tenant:
    tables: dict[str, TableDef] = field(default_factory=dict)
    views: dict[str, ViewDef] = field(default_factory=dict)
    indexes: dict[str, IndexDef] = field(default_factory=dict)


ROWID = "_rowid"
_NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_$]*$")


def oid(kind: str, name: str) -> int:
    """FNV-1a (64 bits) of kind:name, modulo 10 ** 9, plus 10000."""
    h = 0xCBF29CE484222325
    for b in f"{kind}:{name}".encode():
        h = ((h ^ b) * 0x100000001B3) % (1 << 64)
    return h % 1_000_000_000 + 10_000


class Catalog:
    """A catalog under ``root``; in memory only, and of tables without data, if that is None."""

    def __init__(self, spark: SparkSession, root: str | None):
        self.spark, self.root = spark, root and root.rstrip("/")
        self.tenants: dict[int, Tenant] = {}
        self.versions: dict[int, int] = {}
        self.logs: dict[int, TenantLog] = {}

    # Persistence, in the tenant's log.

    def log(self, tenant: int) -> TenantLog:
        if tenant not in self.logs:
            self.logs[tenant] = TenantLog(self.spark, f"{self.root}/tenant={tenant}/_log")
        return self.logs[tenant]

    def tenant(self, tenant: int) -> Tenant:
        if tenant not in self.tenants:
            self.refresh(tenant)
        return self.tenants[tenant]

    def refresh(self, tenant: int) -> None:
        """Takes over what other writers have defined."""
        state = self.log(tenant).latest()[1] if self.root else {"catalog": None, "catalog_version": -1}
        if tenant in self.tenants and self.versions[tenant] == state["catalog_version"]:
            return
        found, said = Tenant(), state["catalog"]
        for t in said["tables"] if said else ():
            columns = tuple(ColumnDef(**c) for c in t["columns"])
            rules = tuple(ConstraintDef(c["name"], c["kind"], tuple(c["columns"]), c["check"], tuple(c["references"])) for c in t["constraints"])
            found.tables[t["name"]] = TableDef(t["name"], columns, rules, t["version"])
        if said:
            found.views = {v["name"]: ViewDef(**v) for v in said["views"]}
            found.indexes = {i["name"]: IndexDef(**{**i, "columns": tuple(i["columns"])}) for i in said["indexes"]}
        self.tenants[tenant], self.versions[tenant] = found, state["catalog_version"]

    def save(self, tenant: int, tables: Mapping[str, tuple[int, Sequence[str] | None]] | None = None) -> None:
        """Commits the definitions, with changed tables if any; if others were faster, takes theirs over and says so."""
        if not self.root:
            return
        t = self.tenant(tenant)
        said = {"tables": [asdict(x) for x in t.tables.values()], "views": [asdict(x) for x in t.views.values()], "indexes": [asdict(x) for x in t.indexes.values()]}
        try:
            self.log(tenant).commit(tables or {}, (self.versions[tenant], said))
            self.versions[tenant] += 1
        except ConflictError:
            del self.tenants[tenant]
            self.refresh(tenant)
            raise

    # Tables.

    def data(self, tenant: int, name: str) -> ManagedTable:
        return ManagedTable(self.spark, f"{self.root}/tenant={tenant}/{name}", self.table(tenant, name).schema(), self.log(tenant))

    def stats(self, tenant: int, name: str) -> ManagedTable:
        """What ANALYZE has stored about a table: a row per column."""
        return ManagedTable(self.spark, f"{self.root}/tenant={tenant}/_stats/{name}", statistics.SCHEMA, self.log(tenant), f"_stats/{name}")

    def table(self, tenant: int, name: str) -> TableDef:
        try:
            return self.tenant(tenant).tables[name]
        except KeyError:
            raise KeyError(f"no table {name}") from None

    def create_table(self, tenant: int, table: TableDef, if_not_exists: bool = False) -> TableDef:
        known = self.tenant(tenant)
        if table.name in known.tables:
            if if_not_exists:
                return known.tables[table.name]
            raise ValueError(f"table {table.name} exists")
        if not _NAME.match(table.name) or not table.columns:
            raise ValueError(f"not a table: {table.name!r} with {len(table.columns)} columns")
        names = [c.name for c in table.columns]
        if len({n.lower() for n in names}) < len(names) or not all(map(_NAME.match, names)):
            raise ValueError(f"bad column names: {names}")
        for c in table.columns:
            kinds.name_of(c.type)
        for rule in table.constraints:
            self._check_rule(tenant, table, rule)
        known.tables[table.name] = table
        self.save(tenant)
        return table

    def drop_table(self, tenant: int, name: str, if_exists: bool = False) -> bool:
        known = self.tenant(tenant)
        if name not in known.tables:
            if if_exists:
                return False
            raise KeyError(f"no table {name}")
        gone = (self.data(tenant, name), self.stats(tenant, name))
        bases = {data.name: (data.version(), None) for data in gone}
        del known.tables[name]
        known.indexes = {k: i for k, i in known.indexes.items() if i.table != name}
        self.save(tenant, bases)
        for data in gone:
            data.drop()
        return True

    def _replace(self, tenant: int, table: TableDef, tables: Mapping[str, tuple[int, Sequence[str]]] | None = None) -> TableDef:
        table = replace(table, version=table.version + 1)
        self.tenant(tenant).tables[table.name] = table
        self.save(tenant, tables)
        return table

    def _rewrite(self, tenant: int, new: TableDef, rows: DataFrame, base: int) -> TableDef:
        """Commits rows in the new shape together with the definition."""
        if base < 0:
            return self._replace(tenant, new)
        folder = self.data(tenant, new.name).write(rows.select(*new.schema().fieldNames()), base)
        return self._replace(tenant, new, {new.name: (base, [folder])})

    def add_column(self, tenant: int, name: str, column: ColumnDef) -> TableDef:
        table, data = self.table(tenant, name), self.data(tenant, name)
        if column.name in {c.name for c in table.columns}:
            raise ValueError(f"column {column.name} exists")
        base = data.version()
        if not column.nullable and column.default is None and base >= 0 and data.read(base).limit(1).count():
            raise ValueError(f"column {column.name} may not be null and has no default")
        rows = data.read(base).withColumn(column.name, F.lit(column.default).cast(kinds.spark_type(column.type)))
        return self._rewrite(tenant, replace(table, columns=(*table.columns, column)), rows, base)

    def drop_column(self, tenant: int, name: str, column: str) -> TableDef:
        table, data = self.table(tenant, name), self.data(tenant, name)
        table.column(column)
        base = data.version()
        left = tuple(c for c in table.columns if c.name != column)
        rules = tuple(r for r in table.constraints if column not in r.columns)
        return self._rewrite(tenant, replace(table, columns=left, constraints=rules), data.read(base).drop(column), base)

    def alter_type(self, tenant: int, name: str, column: str, kind: str) -> TableDef:
        table, data = self.table(tenant, name), self.data(tenant, name)
        table.column(column)
        base = data.version()
        columns = tuple(replace(c, type=kind) if c.name == column else c for c in table.columns)
        return self._rewrite(tenant, replace(table, columns=columns), data.read(base).withColumn(column, kinds.convert(F.col(column), kind)), base)

    # Constraints.

    def _check_rule(self, tenant: int, table: TableDef, rule: ConstraintDef) -> None:
        if rule.kind not in ("primary_key", "unique", "foreign_key", "check", "not_null"):
            raise ValueError(f"unknown constraint: {rule.kind}")
        for c in rule.columns:
            table.column(c)
        if rule.kind == "check" and not rule.check:
            raise ValueError("a check needs an expression")
        if rule.kind != "check" and not rule.columns:
            raise ValueError(f"{rule.kind} needs columns")
        if rule.kind == "foreign_key":
            other = self.table(tenant, rule.references[0])
            if len(rule.references) - 1 != len(rule.columns):
                raise ValueError("a foreign key needs as many columns as it references")
            for c in rule.references[1:]:
                other.column(c)

    def add_constraint(self, tenant: int, name: str, rule: ConstraintDef) -> TableDef:
        table = self.table(tenant, name)
        if rule.name in {r.name for r in table.constraints}:
            raise ValueError(f"constraint {rule.name} exists")
        self._check_rule(tenant, table, rule)
        new = replace(table, constraints=(*table.constraints, rule))
        self.enforce(tenant, new, self.data(tenant, name).read(), [rule])
        return self._replace(tenant, new)

    def drop_constraint(self, tenant: int, name: str, rule: str) -> TableDef:
        table = self.table(tenant, name)
        if rule not in {r.name for r in table.constraints}:
            raise KeyError(f"no constraint {rule}")
        return self._replace(tenant, replace(table, constraints=tuple(r for r in table.constraints if r.name != rule)))

    def rules(self, table: TableDef) -> list[ConstraintDef]:
        """Table constraints and those of single columns."""
        out = list(table.constraints)
        if keys := tuple(c.name for c in table.columns if c.primary_key):
            out.append(ConstraintDef(f"{table.name}_pkey", "primary_key", keys))
        out += [ConstraintDef(f"{table.name}_{c.name}_key", "unique", (c.name,)) for c in table.columns if c.unique and not c.primary_key]
        out += [ConstraintDef(f"{table.name}_{c.name}_not_null", "not_null", (c.name,)) for c in table.columns if not c.nullable]
        return out

    def violations(self, tenant: int, rows: DataFrame, rule: ConstraintDef) -> DataFrame:
        """Rows (or keys) that break a constraint."""
        from granary.operators import constraints as checks

        match rule.kind:
            case "not_null":
                return checks.null_rows(rows, rule.columns)
            case "unique":
                return checks.repeated_keys(rows, rule.columns)
            case "primary_key":
                return checks.repeated_keys(rows, rule.columns).select(*rule.columns).unionByName(checks.null_rows(rows, rule.columns).select(*rule.columns))
            case "check":
                return checks.failing_rows(rows, rule.check)
        return checks.orphans(rows, rule.columns, self.data(tenant, rule.references[0]).read(), rule.references[1:])

    def enforce_new(self, tenant: int, table: TableDef, fresh: DataFrame, old: DataFrame) -> None:
        """Checks rows to be added: each by itself, keys among them and against the rows that are there."""
        self.enforce(tenant, table, fresh)
        for rule in self.rules(table):
            if rule.kind in ("unique", "primary_key"):
                keys = old.select(*(F.col(c).alias(f"__{c}") for c in rule.columns))
                met = fresh.join(keys, [F.col(c) == F.col(f"__{c}") for c in rule.columns], "left_semi").select(*rule.columns)
                if bad := met.take(1):
                    raise ValueError(f"{table.name}: constraint {rule.name} ({rule.kind}) is broken by {bad[0].asDict()}")

    def enforce(self, tenant: int, table: TableDef, rows: DataFrame, rules: Sequence[ConstraintDef] | None = None) -> None:
        for rule in self.rules(table) if rules is None else rules:
            if bad := self.violations(tenant, rows, rule).take(1):
                raise ValueError(f"{table.name}: constraint {rule.name} ({rule.kind}) is broken by {bad[0].asDict()}")

    # Views and indexes.

    def create_view(self, tenant: int, view: ViewDef, or_replace: bool = False) -> ViewDef:
        known = self.tenant(tenant)
        if view.name in known.tables or (view.name in known.views and not or_replace):
            raise ValueError(f"{view.name} exists")
        known.views[view.name] = view
        self.save(tenant)
        return view

    def drop_view(self, tenant: int, name: str, if_exists: bool = False) -> bool:
        return self._drop(tenant, self.tenant(tenant).views, "view", name, if_exists)

    def create_index(self, tenant: int, index: IndexDef, if_not_exists: bool = False) -> IndexDef:
        """Metadata; a unique index is checked against the rows, as a constraint would be."""
        known, table = self.tenant(tenant), self.table(tenant, index.table)
        if index.name in known.indexes:
            if if_not_exists:
                return known.indexes[index.name]
            raise ValueError(f"index {index.name} exists")
        for c in index.columns:
            table.column(c)
        if index.unique:
            self.enforce(tenant, table, self.data(tenant, index.table).read(), [ConstraintDef(index.name, "unique", index.columns)])
        known.indexes[index.name] = index
        self.save(tenant)
        return index

    def drop_index(self, tenant: int, name: str, if_exists: bool = False) -> bool:
        return self._drop(tenant, self.tenant(tenant).indexes, "index", name, if_exists)

    def _drop(self, tenant: int, held: dict, kind: str, name: str, if_exists: bool) -> bool:
        if name not in held:
            if if_exists:
                return False
            raise KeyError(f"no {kind} {name}")
        del held[name]
        self.save(tenant)
        return True

    def list_tables(self, tenant: int) -> list[str]:
        return sorted(self.tenant(tenant).tables)

    def list_views(self, tenant: int) -> list[str]:
        return sorted(self.tenant(tenant).views)

    def list_indexes(self, tenant: int, table: str | None = None) -> list[str]:
        return sorted(i.name for i in self.tenant(tenant).indexes.values() if table in (None, i.table))


def inferred(name: str, rows: Sequence[Mapping[str, Any]]) -> TableDef:
    """A table for these rows: all columns nullable, each typed by its first value that isn't None."""
    found: dict[str, str] = {}
    for row in rows:
        for k, v in row.items():
            if v is not None:
                found.setdefault(k, kinds.infer(v))
    names = dict.fromkeys(k for row in rows for k in row)
    return TableDef(name, tuple(ColumnDef(k, found.get(k, "string")) for k in names))
