"""Access-control lists: entries, effective privileges and grant statements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import qualified, quote_ident
from .catalog import FLEET, function_signature, relations, with_owner

# Privilege letters in statement order, and whether the statement names the object kind.
LETTERS = [
    ("a", "INSERT", False), ("r", "SELECT", False), ("w", "UPDATE", False), ("d", "DELETE", False), ("R", "RULE", False),
    ("x", "REFERENCES", False), ("t", "TRIGGER", False), ("U", "USAGE", True), ("C", "CREATE", True), ("T", "TEMP", True),
    ("X", "EXECUTE", True),
]
# Letter sets that amount to all privileges of a kind, plain and with grant option.
ALL_ON_TABLE = ("arwdRxt", "a*r*w*d*R*x*t*")
ALL_ON_KIND = (("UC", "U*C*"), ("CT", "C*T*"))
SERVER_USER = "rdsdb"
PUBLIC = "PUBLIC"
GRANT_ORDER = {"database": 0, "schema": 1, "language": 1, "table": 2, "view": 2, "function": 2, "default acl": 3}
REVOKE_ORDER = {"default acl": 0, "function": 1, "table": 1, "view": 1, "schema": 2, "language": 2, "database": 3}

_ACL_OUT = ["object_owner", "schema_name", "object_name", "object_type"]


def default_acl_object() -> Column:
    return F.when(F.col("defaclobjtype") == "r", "tables").when(F.col("defaclobjtype") == "f", "functions")


def acl_entries(classes: DataFrame, ns: DataFrame, db: DataFrame, proc: DataFrame, languages: DataFrame, defacl: DataFrame, users: DataFrame, *,
                fleet=FLEET) -> DataFrame:
    """Every ACL entry of the six object kinds, parsed: grantee, grantor, letters and place in the list."""
    fleet = list(fleet)
    none = F.lit(None).cast("string")

    def part(df, owner, schema, name, kind, acl):
        owned = with_owner(df, users, owner, fleet) if owner else df.withColumn("owner_name", none)
        return owned.select(*fleet, F.col("owner_name").alias("object_owner"), schema.alias("schema_name"), name.alias("object_name"),
                            kind.alias("object_type"), F.posexplode(acl).alias("pos", "item"))

    n = lambda key: ns.select(*fleet, F.col("oid").alias(key), F.trim("nspname").alias("schema_name"))
    rel_kind = F.when(F.col("relkind") == "r", "table").otherwise("view")
    parts = [
        part(relations(classes, ns, fleet).where(F.col("relkind").isin("r", "v")), "relowner", F.trim("schema_name"), F.col("relname"), rel_kind, "relacl"),
        part(ns, "nspowner", none, F.col("nspname"), F.lit("schema"), "nspacl"),
        part(db, "datdba", none, F.col("datname"), F.lit("database"), "datacl"),
        part(proc.join(n("pronamespace"), [*fleet, "pronamespace"]), "proowner", F.col("schema_name"), function_signature(), F.lit("function"), "proacl"),
        part(languages, None, none, F.col("lanname"), F.lit("language"), "lanacl"),
        part(defacl.join(n("defaclnamespace"), [*fleet, "defaclnamespace"], "left"), "defacluser", F.col("schema_name"), default_acl_object(),
             F.lit("default acl"), "defaclacl"),
    ]
    item = F.trim("item")
    raw = F.split_part(item, F.lit("="), F.lit(1))
    grantor = F.split_part(item, F.lit("/"), F.lit(2))
    plain = lambda c: F.translate(F.trim(c), '"', "")
    # a catalog is a small file read by few tasks: its entries are dealt to all tasks before they are parsed
    listed = reduce(DataFrame.unionByName, parts)
    return listed.repartition(F.xxhash64(*listed.columns)).select(
        *fleet, *_ACL_OUT, F.when(raw == "", PUBLIC).otherwise(plain(raw)).alias("grantee"), plain(grantor).alias("grantor"),
        F.trim(F.split_part(F.split_part(item, F.lit("="), F.lit(2)), F.lit("/"), F.lit(1))).alias("privilege"),
        F.when(raw == "", PUBLIC).otherwise(F.trim(raw)).alias("grantee_quoted"), (F.col("pos") + 1).alias("grant_seq"))


def acl_explode(entries: DataFrame) -> DataFrame:
    """ACL entries without owners' grants to themselves and without the server's own."""
    return entries.where((F.col("grantee") != F.col("grantor")) & (F.col("grantee") != SERVER_USER)
                         & ~((F.col("grantee") == PUBLIC) & (F.col("grantor") == SERVER_USER)))


def _full_name() -> Column:
    both = F.coalesce(qualified("schema_name", "object_name"), quote_ident("object_name"))
    kind = F.col("object_type")
    return (F.when(kind == "default acl", F.col("object_name")).when((kind == "function") & F.col("schema_name").rlike("[^a-z]"), F.col("object_name"))
            .when(kind == "function", F.concat(quote_ident("schema_name"), F.lit("."), F.col("object_name"))).otherwise(both))


def _look_up(kind: Column, order: dict[str, int]) -> Column:
    return reduce(lambda c, kv: c.when(kind == kv[0], kv[1]), order.items(), F.when(F.lit(False), 0))


def grant_revoke_text(entries: DataFrame, defacl: DataFrame, users: DataFrame, *, acting_user: str | None = None, fleet=FLEET) -> DataFrame:
    """Grant and revoke statements rebuilding or removing each ACL entry, with their order."""
    fleet = list(fleet)
    e = acl_explode(entries).withColumns({"full_name": _full_name(), "quoted_grantor": quote_ident("grantor")})
    kind, priv = F.col("object_type"), F.col("privilege")
    is_default = kind == "default acl"
    to = lambda word: F.concat(F.lit(f" {word} "), F.col("grantee_quoted"))
    as_default = F.concat(F.lit("ALTER DEFAULT PRIVILEGES for user "), F.col("quoted_grantor"),
                          F.coalesce(F.concat(F.lit(" in schema "), quote_ident("schema_name"), F.lit(" ")), F.lit(" ")))
    head = F.when(is_default, as_default).otherwise("")
    other = (F.col("grantor") != F.lit(acting_user or "")) & (F.col("grantor") != SERVER_USER) & ~is_default

    def framed(cond, text):
        return F.concat(F.when(cond, F.concat(F.lit("SET SESSION AUTHORIZATION "), F.col("quoted_grantor"), F.lit(";"))).otherwise(""), text,
                        F.when(cond, "RESET SESSION AUTHORIZATION;").otherwise(""))

    def grant(what, on_kind, with_option):
        on = {True: F.concat(kind, F.lit(" ")), False: F.lit(""), None: F.when(is_default, "").otherwise(F.concat(kind, F.lit(" ")))}[on_kind]
        return F.concat(head, F.lit(f"GRANT {what} on "), on, F.col("full_name"), to("to"), F.when(with_option, " with grant option;").otherwise(";"))

    body = F.when(priv.isin(*ALL_ON_TABLE), grant("ALL", False, priv == ALL_ON_TABLE[1]))
    for plain, option in ALL_ON_KIND:
        body = body.when(priv.isin(plain, option), grant("ALL", True, priv == option))
    each = [F.when(F.instr(priv, letter) > 0, grant(word, None if letter == "X" else on_kind, F.instr(priv, letter + "*") > 0)).otherwise("")
            for letter, word, on_kind in LETTERS]
    body = body.otherwise(F.concat(*each))
    shape = lambda ddl_type, order, text: F.struct(
        F.lit(ddl_type).alias("ddl_type"), F.col("grant_seq").cast("int").alias("grant_seq"), order.cast("int").alias("object_seq"), text.alias("ddl"))
    on = F.when(kind.isin("table", "view") | is_default, "").otherwise(F.concat(kind, F.lit(" ")))
    revoke = F.concat(head, F.lit("REVOKE ALL on "), on, F.col("full_name"), to("FROM"), F.lit(";"))
    # both statements of an entry come from one reading of it
    granted = shape("grant", _look_up(kind, GRANT_ORDER), framed(other, body))
    revoked = F.when(~(is_default & (F.col("grantee") == PUBLIC) & (F.col("object_name") == "functions")), shape(
        "revoke", _look_up(kind, REVOKE_ORDER), framed(other & (F.col("grantor") != F.coalesce("object_owner", F.lit(""))), revoke)))
    statements = e.select(*fleet, *_ACL_OUT, "grantor", "grantee", F.inline(F.filter(F.array(granted, revoked), lambda s: s.isNotNull())))
    # database-wide default privileges get back what the revokes took from their owner
    own = with_owner(defacl.where("defaclnamespace = 0"), users, "defacluser", fleet)
    owner = quote_ident("owner_name")
    back = F.concat(F.lit("ALTER DEFAULT PRIVILEGES for user "), owner, F.lit(" GRANT ALL on "), default_acl_object(), F.lit(" TO "), owner,
                    F.when(F.col("defaclobjtype") == "f", ", PUBLIC;").otherwise(";"))
    none = F.lit(None).cast("string")
    restored = own.select(*fleet, none.alias("object_owner"), none.alias("schema_name"), default_acl_object().alias("object_name"),
                          F.lit("default acl").alias("object_type"), F.col("owner_name").alias("grantor"), none.alias("grantee"),
                          F.lit("revoke").alias("ddl_type"), F.lit(5).alias("grant_seq"), F.lit(5).alias("object_seq"), back.alias("ddl"))
    return statements.unionByName(restored)


# Letters that make a user or group a holder of something, per object kind.
TOUCHING = {"table": "rdawx", "view": "rdawx", "schema": "UC", "database": "CT", "function": "X", "language": "U", "default acl": "rdawxX"}


def privileges_touching(entries: DataFrame, defacl: DataFrame, ns: DataFrame, users: DataFrame, *, user=None, fleet=FLEET) -> DataFrame:
    """Privileges a user owns, granted or received, and default lists emptied for their owner."""
    fleet = list(fleet)
    kind = F.col("object_type")
    held = reduce(lambda c, kv: c | ((kind == kv[0]) & F.col("privilege").rlike(f"[{kv[1]}]")), TOUCHING.items(), F.lit(False))
    rows = entries.where(held).select(*fleet, "schema_name", "object_name", "object_type", "object_owner", "grantor", "grantee")
    n = ns.select(*fleet, F.col("oid").alias("defaclnamespace"), F.col("nspname").alias("schema_name"))
    emptied = with_owner(defacl.where(F.size("defaclacl") == 0).join(n, [*fleet, "defaclnamespace"], "left"), users, "defacluser", fleet).select(
        *fleet, "schema_name", default_acl_object().alias("object_name"), F.lit("default acl").alias("object_type"),
        F.col("owner_name").alias("object_owner"), F.lit(None).cast("string").alias("grantor"),
        F.when(F.col("defaclobjtype") == "r", "Regrant privileges on tables to owner").otherwise(
            "Regrant privileges on Functions to owner and PUBLIC").alias("grantee"))
    out = rows.unionByName(emptied).distinct()
    if user is None:
        return out
    return out.where((F.col("object_owner") == user) | (F.col("grantor") == user) | (F.col("grantee") == user))


_GROUP = "group "
SUPERUSERS = "(superusers)"
TABLE_RIGHTS = {"sel": "r", "ins": "a", "upd": "w", "del": "d", "ref": "x"}
SCHEMA_RIGHTS = {"cre": "C", "usg": "U"}


def _effective(objects: DataFrame, users: DataFrame, groups: DataFrame, rights: dict[str, str], names: list[str], fleet, only_users) -> DataFrame:
    """Rights per object and principal. ``objects`` has fleet keys, id, owner, acl and ``names``.

    A user's rights are those granted to the user, to a group of the user's or to everyone, all
    rights on owned objects, and all rights for a superuser. Rights that hold for everyone, or for
    every superuser, stay one row per object: spelling them out would pair all users with all
    objects. ``only_users`` spells everything out for a given short list of names.
    """
    fleet = list(fleet)
    key = [*fleet, "id"]
    acl = objects.select(*key, F.explode("acl").alias("item"))
    grantee = F.translate(F.trim(F.split_part("item", F.lit("="), F.lit(1))), '"', "")
    letters = F.split_part(F.split_part("item", F.lit("="), F.lit(2)), F.lit("/"), F.lit(1))
    acl = acl.select(*key, grantee.alias("grantee"), *[(F.instr(letters, x) > 0).alias(r) for r, x in rights.items()])
    either = [F.bool_or(r).alias(r) for r in rights]
    everyone = acl.where("grantee = ''").groupBy(*key).agg(*either)
    u = users.select(*fleet, "usesysid", F.col("usename").alias("principal"), "usesuper")
    if only_users is not None:
        u = u.where(F.col("principal").isin(*only_users))
    direct = acl.where((F.col("grantee") != "") & ~F.col("grantee").startswith(_GROUP)).withColumnRenamed("grantee", "principal").join(
        u.select(*fleet, "principal"), [*fleet, "principal"], "left_semi")
    members = groups.select(*fleet, F.col("groname").alias("group_name"), F.explode("grolist").alias("usesysid")).join(
        u.select(*fleet, "usesysid", "principal"), [*fleet, "usesysid"])
    by_group = acl.where(F.col("grantee").startswith(_GROUP)).withColumn("group_name", F.expr(f"substring(grantee, {len(_GROUP) + 1})")).join(
        members, [*fleet, "group_name"]).select(*key, "principal", *rights)
    owned = objects.select(*key, F.col("owner").alias("usesysid")).join(u, [*fleet, "usesysid"]).select(
        *key, "principal", *[F.lit(True).alias(r) for r in rights])
    listed = direct.select(*key, "principal", *rights).unionByName(by_group).unionByName(owned)
    if only_users is not None:
        listed = listed.unionByName(objects.select(*key).join(u.select(*fleet, "principal"), fleet).select(
            *key, "principal", *[F.lit(False).alias(r) for r in rights]))
    own = listed.groupBy(*key, "principal").agg(*either)
    shared = everyone.withColumnsRenamed({r: f"{r}_all" for r in rights})
    full = own.join(shared, key, "left").join(u.select(*fleet, "principal", "usesuper"), [*fleet, "principal"])
    user_rows = full.select(*key, "principal", F.lit("user").alias("principal_kind"),
                            *[(F.col(r) | F.coalesce(F.col(f"{r}_all"), F.lit(False)) | F.col("usesuper")).alias(r) for r in rights])
    rows = user_rows
    if only_users is None:
        rows = rows.unionByName(everyone.select(*key, F.lit(PUBLIC).alias("principal"), F.lit("public").alias("principal_kind"), *rights)).unionByName(
            objects.select(*key, F.lit(SUPERUSERS).alias("principal"), F.lit("superuser").alias("principal_kind"), *[F.lit(True).alias(r) for r in rights]))
    some = reduce(lambda a, b: a | b, [F.col(r) for r in rights])
    return rows.where(some).join(objects.select(*key, *names), key).select(*fleet, *names, "principal", "principal_kind", *rights)


def effective_table_privileges(classes: DataFrame, ns: DataFrame, users: DataFrame, groups: DataFrame, *, kinds=("r", "v"), only_users=None,
                               fleet=FLEET) -> DataFrame:
    """Who may select, insert, update, delete or reference which table or view."""
    fleet = list(fleet)
    objects = relations(classes, ns, fleet).where(F.col("relkind").isin(*kinds) & (F.col("schema_name") != "pg_internal")).select(
        *fleet, F.col("oid").alias("id"), F.col("relowner").alias("owner"), F.col("relacl").alias("acl"), "schema_name",
        F.col("relname").alias("object_name"), F.when(F.col("relkind") == "v", "v").otherwise("t").alias("object_type"))
    return _effective(objects, users, groups, TABLE_RIGHTS, ["schema_name", "object_name", "object_type"], fleet, only_users)


def effective_schema_privileges(ns: DataFrame, users: DataFrame, groups: DataFrame, *, only_users=None, fleet=FLEET) -> DataFrame:
    """Who may create in or use which schema."""
    fleet = list(fleet)
    objects = ns.select(*fleet, F.col("oid").alias("id"), F.col("nspowner").alias("owner"), F.col("nspacl").alias("acl"),
                        F.col("nspname").alias("schema_name"))
    return _effective(objects, users, groups, SCHEMA_RIGHTS, ["schema_name"], fleet, only_users)


# Statement word of each table right, in statement order.
RIGHT_WORDS = {"sel": "SELECT", "ins": "INSERT", "upd": "UPDATE", "del": "DELETE", "ref": "REFERENCES"}


def permission_text(effective: DataFrame, *, fleet=FLEET) -> DataFrame:
    """Grant statements giving each principal its effective table rights, one per line."""
    target = F.concat(qualified("schema_name", "object_name"), F.lit(" TO "),
                      F.when(F.col("principal_kind") == "public", PUBLIC).otherwise(quote_ident("principal")), F.lit(";"))
    lines = [F.when(F.col(r), F.concat(F.lit(f"GRANT {w} ON "), target)) for r, w in RIGHT_WORDS.items()]
    return effective.where("principal_kind <> 'superuser'").select(*fleet, "schema_name", "object_name", "principal", F.concat_ws("\n", *lines).alias("ddl"))
