"""Dependencies, ownership, membership and search over catalog snapshots of a fleet.

Every input carries the ``fleet`` key columns (cluster, optionally snapshot time) and every join
includes them, so snapshots of many clusters can be processed in one go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import qualified, quote_ident
from .rows import only

FLEET = ("cluster_id",)


def relations(classes: DataFrame, ns: DataFrame, fleet=FLEET, how: str = "inner") -> DataFrame:
    """Catalog relations with their schema name."""
    fleet = list(fleet)
    n = ns.select(*fleet, F.col("oid").alias("relnamespace"), F.col("nspname").alias("schema_name"))
    return classes.join(n, [*fleet, "relnamespace"], how)


def with_owner(df: DataFrame, users: DataFrame, owner: str, fleet=FLEET, how: str = "left") -> DataFrame:
    fleet = list(fleet)
    u = users.select(*fleet, F.col("usesysid").alias(owner), F.col("usename").alias("owner_name"))
    return df.join(u, [*fleet, owner], how)


def _named(classes: DataFrame, ns: DataFrame, prefix: str, oid: str, fleet) -> DataFrame:
    return relations(classes, ns, fleet, "left").select(
        *fleet, F.col("oid").alias(oid), F.col("schema_name").alias(f"{prefix}_schema"), F.col("relname").alias(f"{prefix}_object"))


def view_dependencies(classes: DataFrame, ns: DataFrame, depend: DataFrame, *, fleet=FLEET) -> DataFrame:
    """Which view depends on which object: both hang on the same rewrite rule."""
    fleet = list(fleet)
    src = depend.select(*fleet, "objid", F.col("refobjid").alias("src_oid")).distinct()
    views = classes.where("relkind = 'v'").select(*fleet, F.col("oid").alias("dependent_oid"))
    # each rule belongs to one view, so this side holds one row per rule
    tgt = depend.where("deptype = 'i'").select(*fleet, "objid", F.col("refobjid").alias("dependent_oid")).distinct().join(
        views, [*fleet, "dependent_oid"], "left_semi")
    edges = src.join(tgt, [*fleet, "objid"]).where("src_oid <> dependent_oid").select(*fleet, "src_oid", "dependent_oid").distinct()
    return edges.join(_named(classes, ns, "src", "src_oid", fleet), [*fleet, "src_oid"]).join(
        _named(classes, ns, "dependent", "dependent_oid", fleet), [*fleet, "dependent_oid"]).select(
        *fleet, "src_oid", "src_schema", "src_object", "dependent_oid", "dependent_schema", "dependent_object")


def fk_dependencies(classes: DataFrame, ns: DataFrame, constraints: DataFrame, *, fleet=FLEET) -> DataFrame:
    """Which table references which through a foreign key."""
    fleet = list(fleet)
    edges = constraints.where("confrelid is not null").select(
        *fleet, F.col("confrelid").alias("src_oid"), F.col("conrelid").alias("dependent_oid"), F.col("conname").alias("constraint_name")).distinct()
    return edges.join(_named(classes, ns, "src", "src_oid", fleet), [*fleet, "src_oid"]).join(
        _named(classes, ns, "dependent", "dependent_oid", fleet), [*fleet, "dependent_oid"]).select(
        *fleet, "src_oid", "src_schema", "src_object", "dependent_oid", "dependent_schema", "dependent_object", "constraint_name")


def object_dependencies(classes: DataFrame, ns: DataFrame, depend: DataFrame, constraints: DataFrame, *, fleet=FLEET) -> DataFrame:
    """View and foreign-key dependencies in one list."""
    views = view_dependencies(classes, ns, depend, fleet=fleet).withColumn("constraint_name", F.lit(None).cast("string"))
    keys = fk_dependencies(classes, ns, constraints, fleet=fleet)
    return views.withColumn("dependency_type", F.lit("view")).unionByName(
        keys.withColumn("dependency_type", F.lit("fkey constraint"))).distinct()


def group_members(groups: DataFrame, users: DataFrame, *, fleet=FLEET) -> DataFrame:
    """Users of each group."""
    fleet = list(fleet)
    return groups.select(*fleet, "groname", "grosysid", F.explode("grolist").alias("usesysid")).join(users, [*fleet, "usesysid"]).select(
        *fleet, "groname", "grosysid", "usesysid", "usename", "usesuper")


def function_signature() -> Column:
    """Function name with its argument types, as the server prints it."""
    args = F.slice("argtypes", F.lit(1), F.col("nargs"))
    return F.concat(quote_ident("proname"), F.lit("("), F.array_join(args, ", "), F.lit(")"))


def objects_owned_by(classes: DataFrame, ns: DataFrame, db: DataFrame, proc: DataFrame, users: DataFrame, libraries: DataFrame | None = None, *,
                     user=None, fleet=FLEET) -> DataFrame:
    """Functions, databases, schemas, tables, views and libraries by owner, with the transfer statement's head."""
    fleet = list(fleet)
    out = ["object_type", "owner_name", "owner_id", "schema_name", "object_name", "transfer_text"]
    say = lambda kind, name: F.concat(F.lit(f"alter {kind} "), name, F.lit(" owner to "))

    def part(df, owner, kind, schema, name, text):
        owned = with_owner(df, users, owner, fleet, "inner")
        return owned.select(*fleet, kind.alias("object_type"), "owner_name", F.col(owner).cast("long").alias("owner_id"), schema.alias("schema_name"),
                            name.alias("object_name"), text.alias("transfer_text"))

    n = ns.select(*fleet, F.col("oid").alias("pronamespace"), F.col("nspname").alias("schema_name"))
    none = F.lit(None).cast("string")
    fn = F.concat(quote_ident("schema_name"), F.lit("."), function_signature())
    kind = F.when(F.col("relkind") == "r", "Table").otherwise("View")
    rel = relations(classes, ns, fleet).where(F.col("relkind").isin("r", "v") & ~F.col("schema_name").ilike("pg\\_temp\\_%"))
    parts = [
        part(proc.join(n, [*fleet, "pronamespace"]), "proowner", F.lit("Function"), F.col("schema_name"), function_signature(), say("function", fn)),
        part(db, "datdba", F.lit("Database"), none, F.col("datname"), say("database", quote_ident("datname"))),
        part(ns, "nspowner", F.lit("Schema"), none, F.col("nspname"), say("schema", quote_ident("nspname"))),
        part(rel, "relowner", kind, F.col("schema_name"), F.col("relname"), say("table", qualified("schema_name", "relname"))),
    ]
    if libraries is not None:
        parts.append(part(libraries, "owner", F.lit("Library"), F.lit(""), F.col("name"), F.lit("No transfer statement exists for a library; replace it instead")))
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return only(result, owner_name=user).select(*fleet, *out)


def search_tables(classes: DataFrame, ns: DataFrame, *, pattern: str, fleet=FLEET) -> DataFrame:
    """Tables and views whose name matches a pattern."""
    return relations(classes, ns, fleet).where(F.col("relname").like(pattern)).select(
        *fleet, "schema_name", F.col("relname").alias("object_name"), "relkind", F.col("oid").alias("table_id"))


def search_columns(classes: DataFrame, ns: DataFrame, attrs: DataFrame, *, pattern: str, fleet=FLEET) -> DataFrame:
    """Columns whose name matches a pattern, with their table."""
    fleet = list(fleet)
    a = attrs.where(F.col("attname").like(pattern)).select(*fleet, F.col("attrelid").alias("oid"), "attnum", "attname", "format_type")
    return a.join(relations(classes, ns, fleet), [*fleet, "oid"]).select(
        *fleet, "schema_name", F.col("relname").alias("table_name"), "attnum", F.col("attname").alias("column_name"), "format_type")


BUILT_IN_LANGUAGES = ("c", "internal")


def search_functions(proc: DataFrame, ns: DataFrame, languages: DataFrame, *, pattern: str = "%", fleet=FLEET) -> DataFrame:
    """Functions outside the system schemas and built-in languages."""
    fleet = list(fleet)
    n = ns.where(~F.col("nspname").like("pg\\_%") & (F.col("nspname") != "information_schema")).select(
        *fleet, F.col("oid").alias("pronamespace"), F.col("nspname").alias("schema_name"))
    lang = languages.where(~F.col("lanname").isin(*BUILT_IN_LANGUAGES)).select(*fleet, F.col("oid").alias("prolang"), "lanname")
    return proc.where(F.col("proname").like(pattern)).join(n, [*fleet, "pronamespace"]).join(lang, [*fleet, "prolang"]).select(
        *fleet, "schema_name", F.col("proname").alias("function_name"), F.col("lanname").alias("language"))


def log_marker(utilitytext: DataFrame, *, marker: str, userid=None, limit: int | None = None) -> DataFrame:
    """When a marker statement ran, newest first: how restarts show up in a log."""
    out = only(utilitytext.where(F.col("text").like(f"%{marker}%")), userid=userid).select("userid", "xid", F.col("endtime").alias("marked_at"))
    return out if limit is None else out.orderBy(F.desc("marked_at"), F.desc("xid")).limit(limit)
