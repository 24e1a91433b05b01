"""Effective access: memberships, matching entries, per-bit evaluation, change points."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rights as R
from ..session import cut_lineage
from .skew import measured_join

WORLD = ["everyone", "authenticated users"]  # fixed values: principals that always match
MARKER = "[UNAVAILABLE]"


def bare(account: Column | str) -> Column:
    """Account name without its domain, lower case."""
    return F.lower(F.substring_index(account, "\\", -1))


def is_qualified(account: Column | str) -> Column:
    return F.contains(F.col(account) if isinstance(account, str) else account, F.lit("\\"))


# --- memberships -----------------------------------------------------------

def with_primary_groups(member_of: DataFrame, primary: DataFrame) -> DataFrame:
    """Add the primary group of each principal: its SID with the last part replaced.

    ``primary(sid, primary_group_id)``.
    """
    group = F.concat(F.regexp_replace("sid", "-[0-9]+$", "-"), F.col("primary_group_id").cast("string"))
    edges = primary.where(F.col("primary_group_id").isNotNull()).select(
        F.col("sid").alias("member_sid"), group.alias("group_sid")
    )
    return member_of.unionByName(edges).distinct()


def group_closure(member_of: DataFrame) -> DataFrame:
    """``(member_sid, group_sid, depth)`` with the shortest depth, at any nesting, safe for cycles.

    The graph of groups only, which has no user in it, is closed by doubling:
    after a round, all pairs up to depth ``2^k`` are known; a shortest way of up to
    twice that begins with one of exactly ``2^k`` steps, so only those pairs are
    joined to the known ones. A chain of n groups takes log2(n) rounds; each
    writes one table anew and asks whether any pair is that deep.
    """
    edges = member_of.select("member_sid", "group_sid").distinct()
    nested = edges.join(edges.select(F.col("group_sid").alias("member_sid")).distinct(), "member_sid", "left_semi")
    known = cut_lineage(nested.select(F.col("member_sid").alias("start"), "group_sid", F.lit(1).alias("depth")))
    for k in count():
        farthest = known.where(F.col("depth") == 2**k)
        if farthest.isEmpty():
            break
        first = farthest.select("start", F.col("group_sid").alias("via"))
        rest = known.select(F.col("start").alias("via"), "group_sid", (F.col("depth") + 2**k).alias("depth"))
        longer = measured_join(rest, first, ["via"]).select("start", "group_sid", "depth")
        known = cut_lineage(known.unionByName(longer).groupBy("start", "group_sid").agg(F.min("depth").alias("depth")))
    direct = edges.select("member_sid", "group_sid", F.lit(1).alias("depth"))
    above = known.select(F.col("start").alias("via"), F.col("group_sid").alias("upper"), F.col("depth").alias("more"))
    indirect = measured_join(edges.withColumnRenamed("group_sid", "via"), above, ["via"]).select(
        "member_sid", F.col("upper").alias("group_sid"), (F.col("more") + 1).alias("depth")
    )
    return direct.unionByName(indirect).groupBy("member_sid", "group_sid").agg(F.min("depth").alias("depth"))


def memberships(accounts: DataFrame, closure: DataFrame, principals: DataFrame) -> DataFrame:
    """Groups of each audited account, direct ones first."""
    groups = principals.select(F.col("sid").alias("group_sid"), F.col("account").alias("group_account"))
    return (
        accounts.select("target", F.col("sid").alias("member_sid"))
        .join(closure, "member_sid")
        .join(groups, "group_sid", "left")
        .select("target", "group_sid", "group_account", "depth", (F.col("depth") == 1).alias("is_direct"))
        .orderBy("target", F.desc("is_direct"), F.lower("group_account"))
    )


# --- matching --------------------------------------------------------------

def _keys(*pairs: tuple[str, Column]) -> Column:
    return F.explode(F.array_compact(F.array(*[
        F.when(key.isNotNull() & (key != ""), F.struct(F.lit(kind).alias("kind"), key.alias("key"))) for kind, key in pairs
    ])))


def tokens(accounts: DataFrame, closure: DataFrame, principals: DataFrame) -> DataFrame:
    """Everything an account is known by: itself, its groups, the world principals.

    A SID is the first proof; a full name the second; a bare name counts only for
    a name given without domain.
    """
    own_bare = F.when(~is_qualified("account"), F.lower("account"))
    direct = accounts.select(
        "target", F.lit(0).alias("rank"), F.lit(0).alias("depth"), F.concat(F.lit("Direct: "), F.col("account")).alias("label"),
        _keys(("sid", F.lower("sid")), ("account", F.lower("account")), ("bare", own_bare)).alias("k"),
    )
    names = principals.select(F.col("sid").alias("group_sid"), F.col("account").alias("group_account"))
    groups = accounts.select("target", F.col("sid").alias("member_sid")).join(closure, "member_sid").join(names, "group_sid", "left")
    group_bare = F.when(~is_qualified("group_account"), F.lower("group_account"))
    label = F.concat(
        F.lit("Group: "), F.coalesce("group_account", "group_sid"),
        F.when(F.col("depth") > 1, F.concat(F.lit(" (depth "), F.col("depth").cast("string"), F.lit(")"))).otherwise(F.lit("")),
    )
    via = groups.select(
        "target", F.lit(1).alias("rank"), "depth", label.alias("label"),
        _keys(("sid", F.lower("group_sid")), ("account", F.lower("group_account")), ("plain", group_bare)).alias("k"),
    )
    world = accounts.select(
        "target", F.lit(2).alias("rank"), F.lit(0).alias("depth"), F.lit("Special").alias("label"),
        F.explode(F.array(*[F.struct(F.lit("bare").alias("kind"), F.lit(w).alias("key")) for w in WORLD])).alias("k"),
    )
    both = direct.unionByName(via).unionByName(world)
    return both.select("target", "rank", "depth", "label", "k.kind", "k.key").distinct()


def known_identities(aces: DataFrame, identity_tokens: DataFrame) -> DataFrame:
    """Distinct identities of the entries that speak about each account, with the best proof."""
    identities = aces.select("sid", "account").distinct()
    keyed = identities.select(
        "sid", "account",
        _keys(("sid", F.lower("sid")), ("account", F.lower("account")), ("bare", bare("account")),
              ("plain", F.when(~is_qualified("account"), F.lower("account")))).alias("k"),
    ).select("sid", "account", "k.kind", "k.key")
    best = keyed.join(identity_tokens, ["kind", "key"]).groupBy("target", "sid", "account").agg(
        F.min(F.struct("rank", "depth", "label")).alias("m")
    )
    return best.select(
        "target", F.col("sid").alias("_sid"), F.col("account").alias("_account"), F.col("m.rank").alias("rank"),
        F.col("m.depth").alias("membership_depth"), F.col("m.label").alias("label"),
    )


def matched_aces(aces: DataFrame, identity_tokens: DataFrame) -> DataFrame:
    """Entries that speak about an account, once per account, folder and position.

    Matching runs on the distinct identities; entries join the result on
    identity, so names are compared once per principal and not once per entry.
    """
    return entries_of(aces, known_identities(aces, identity_tokens))


def entries_of(aces: DataFrame, known: DataFrame) -> DataFrame:
    """The entries of each account's ``known`` identities."""
    # One key that tells null from empty, so that an identity with most entries can be spread.
    told = lambda sid, account: F.to_json(F.array(sid, account))
    held = aces.withColumn("_identity", told(F.col("sid"), F.col("account")))
    named = known.withColumn("_identity", told(F.col("_sid"), F.col("_account"))).drop("_sid", "_account")
    return measured_join(held, named, ["_identity"]).drop("_identity")


# --- evaluation ------------------------------------------------------------

def effective_rights(matched: DataFrame) -> DataFrame:
    """Rights per account and folder: the first matching entry decides each bit.

    That is the ordered walk (a deny takes bits not yet granted, an allow bits not
    yet denied) seen bit by bit. One aggregation with a minimum per bit keeps it
    a partial aggregation; no bit becomes a row.
    """
    here = matched.where(~R.has_all("prop_flags", R.INHERIT_ONLY))
    deny = (F.col("access_type") == "Deny").cast("int")
    code = F.col("ace_order") * 4 + deny * 2 + F.col("is_inherited").cast("int")
    suffix = F.when(F.col("is_inherited"), F.lit(" (inherited)")).otherwise(F.lit(""))
    special = F.col("rank") == 2
    label = F.concat(F.when(special, F.concat(F.lit("Special: "), bare("account"))).otherwise(F.col("label")), suffix)
    masks = [1 << b for b in range(31)] + [-(1 << 31)]
    per_bit = [F.min(F.when(F.col("rights").bitwiseAND(m) != 0, code)).alias(f"_b{i}") for i, m in enumerate(masks)]
    # An access list is at most 64 KB, which bounds the labels of one folder.
    decided = here.groupBy("target", "path_key").agg(
        *per_bit, F.array_sort(F.collect_list(F.struct("ace_order", label.alias("label")))).alias("_labels")
    )
    codes = [F.col(f"_b{i}") for i in range(32)]

    def gather(test) -> Column:
        out = F.lit(0)
        for c, m in zip(codes, masks):
            out = out.bitwiseOR(F.when(F.coalesce(test(c), F.lit(False)), F.lit(m)).otherwise(F.lit(0)))
        return out

    allowed = lambda c: c.bitwiseAND(2) == 0
    explicit = gather(lambda c: allowed(c) & (c.bitwiseAND(1) == 0))
    denied = gather(lambda c: c.bitwiseAND(2) != 0)
    givers = F.array_compact(F.array(*[F.when(allowed(c), F.shiftright(c, 2)) for c in codes]))
    out = decided.select(
        "target", "path_key", gather(allowed).alias("allowed"), denied.alias("denied"), explicit.alias("_explicit"),
        F.filter("_labels", lambda l: F.array_contains(givers, l["ace_order"])).alias("_given"),
    )
    traces = F.array_distinct(F.transform("_given", lambda l: l["label"]))
    return out.select(
        "target", "path_key", R.level("allowed").alias("level"), "allowed", "denied", (F.col("denied") != 0).alias("has_deny"),
        ((F.col("_explicit") == 0) & (F.col("allowed") != 0)).alias("is_inherited"),
        F.get(traces, F.lit(0)).alias("grant_source"), F.array_join(traces, " / ").alias("grant_trace"),
    ).where((F.col("allowed") != 0) & (F.col("level") != "None"))


def rights_by_fold(matched: DataFrame) -> DataFrame:
    """The same rights by walking each folder's entries in order: the cross-check of the bit rule."""
    here = matched.where(~R.has_all("prop_flags", R.INHERIT_ONLY))
    walked = here.groupBy("target", "path_key").agg(
        F.array_sort(F.collect_list(F.struct("ace_order", "rights", "access_type"))).alias("_aces")
    )
    start = F.struct(F.lit(0).alias("allowed"), F.lit(0).alias("denied"))

    def step(s: Column, a: Column) -> Column:
        is_deny = a["access_type"] == "Deny"
        fresh_deny = a["rights"].bitwiseAND(F.bitwise_not(s["allowed"]))
        fresh_allow = a["rights"].bitwiseAND(F.bitwise_not(s["denied"]))
        return F.struct(
            F.when(is_deny, s["allowed"]).otherwise(s["allowed"].bitwiseOR(fresh_allow)).alias("allowed"),
            F.when(is_deny, s["denied"].bitwiseOR(fresh_deny)).otherwise(s["denied"]).alias("denied"),
        )

    return walked.select("target", "path_key", F.aggregate("_aces", start, step).alias("r")).select(
        "target", "path_key", "r.allowed", "r.denied"
    )


# --- change points ---------------------------------------------------------

_ITEM = ["target", "path_key", "folder_name", "level", "allowed", "denied", "has_deny", "is_inherited",
         "grant_source", "grant_trace", "change_type"]


def change_points(access: DataFrame, folders: DataFrame, accounts: DataFrame) -> DataFrame:
    """Accessible, severed and unavailable folders of each account with their change type.

    ``accounts(target, root_key, ...)`` names the audited root of each account.
    """
    place = folders.select("path_key", "parent_key", "folder_name", "depth", "readable")
    parent_state = folders.select(F.col("path_key").alias("parent_key"), (~F.col("readable")).alias("_parent_unreadable"))
    parent_access = access.select(
        "target", F.col("path_key").alias("parent_key"), F.col("level").alias("_p_level"), F.col("allowed").alias("_p_allowed")
    )
    readable = folders.where("readable").select("path_key")
    here = access.join(place.where("readable").drop("readable"), "path_key")
    joined = measured_join(measured_join(here, parent_state, ["parent_key"], "left"), parent_access, ["target", "parent_key"], "left")
    same = (F.col("level") == F.col("_p_level")) & (F.col("allowed") == F.col("_p_allowed"))
    change = (
        F.when(F.col("depth") == 0, "Baseline")
        .when(F.coalesce("_parent_unreadable", F.lit(False)), "Unknown")
        .when(F.col("_p_level").isNull(), "EnclaveGranted")
        .when(same & F.col("is_inherited"), "InheritedSame")
        .when(same, "ExplicitBoundary")
        .otherwise("PermissionChanged")
    )
    accessible = joined.withColumn("change_type", change).select(*_ITEM)

    nothing = [
        F.lit("None").alias("level"), F.lit(0).alias("allowed"), F.lit(0).alias("denied"),
    ]
    above = access.join(readable, "path_key", "left_semi").select("target", F.col("path_key").alias("parent_key"), F.col("level").alias("_p_level"))
    below = measured_join(folders.where("readable").select("path_key", "parent_key", "folder_name"), above, ["parent_key"])
    lost = below.join(access.select("target", "path_key"), ["target", "path_key"], "left_anti")
    severed = lost.select(
        "target", "path_key", "folder_name", *nothing, F.lit(True).alias("has_deny"), F.lit(False).alias("is_inherited"),
        F.lit("Severed").alias("grant_source"), F.concat(F.lit("Parent had "), F.col("_p_level")).alias("grant_trace"),
        F.lit("InheritanceSevered").alias("change_type"),
    )
    closed = folders.where(~F.col("readable")).join(accounts.select("target", "root_key").distinct(), "root_key")
    unavailable = closed.select(
        "target", "path_key", "folder_name", *nothing, F.lit(False).alias("has_deny"), F.lit(False).alias("is_inherited"),
        F.lit("Unavailable").alias("grant_source"), F.lit("Unavailable").alias("grant_trace"),
        F.lit("ScanUnavailable").alias("change_type"),
    )
    return accessible.unionByName(severed).unionByName(unavailable)


def report_counts(items: DataFrame) -> DataFrame:
    """Counts of an access report per account."""
    open_ = ~F.col("change_type").isin("InheritanceSevered", "ScanUnavailable")
    is_level = lambda *names: F.count_if(open_ & F.col("level").isin(*names))
    is_type = lambda name: F.count_if(F.col("change_type") == name)
    return items.groupBy("target").agg(
        is_level("FullControl").alias("full_control"), is_level("Modify").alias("modify"), is_level("Custom").alias("custom"),
        is_level("ReadAndExecute", "Read").alias("read_only"), is_type("EnclaveGranted").alias("enclave"),
        is_type("ExplicitBoundary").alias("explicit_boundary"), is_type("InheritanceSevered").alias("severed"),
        is_type("ScanUnavailable").alias("unavailable"), F.count_if(open_).alias("accessible"),
    )


_BITS = [f"_b{i}" for i in range(32)]
_MASKS = [1 << b for b in range(31)] + [-(1 << 31)]


def _first_entries(matched: DataFrame) -> DataFrame:
    """The first entry of every bit per account and folder, as the code ``effective_rights`` decides by."""
    here = matched.where(~R.has_all("prop_flags", R.INHERIT_ONLY))
    code = F.col("ace_order") * 4 + (F.col("access_type") == "Deny").cast("int") * 2 + F.col("is_inherited").cast("int")
    return here.groupBy("target", "path_key").agg(
        *[F.min(F.when(F.col("rights").bitwiseAND(m) != 0, code)).alias(name) for name, m in zip(_BITS, _MASKS)]
    )


def _decided(codes: DataFrame) -> DataFrame:
    """The first entries as ``state`` ``(level, allowed, is_inherited)``; null without access."""
    def gather(test) -> Column:
        out = F.lit(0)
        for name, m in zip(_BITS, _MASKS):
            out = out.bitwiseOR(F.when(F.coalesce(test(F.col(name)), F.lit(False)), F.lit(m)).otherwise(F.lit(0)))
        return out

    allowed = gather(lambda c: c.bitwiseAND(2) == 0)
    explicit = gather(lambda c: c.bitwiseAND(3) == 0)
    plain = codes.withColumn("_allowed", allowed).withColumn("_explicit", explicit).drop(*_BITS).withColumn("_level", R.level("_allowed"))
    state = F.when(
        (F.col("_allowed") != 0) & (F.col("_level") != "None"),
        F.struct(F.col("_level").alias("level"), F.col("_allowed").alias("allowed"), (F.col("_explicit") == 0).alias("is_inherited")),
    )
    return plain.withColumn("state", state).drop("_allowed", "_explicit", "_level")


_COUNTS = ["full_control", "modify", "custom", "read_only", "enclave", "explicit_boundary", "severed", "unavailable", "accessible"]


def _kind(own: Column, above: Column) -> Column:
    """``level`` and ``change_type`` a readable folder has for an account; null when it is no item. See ``change_points``."""
    same = (own["level"] == above["level"]) & (own["allowed"] == above["allowed"])
    change = (
        F.when(F.col("depth") == 0, "Baseline").when(F.coalesce("_parent_closed", F.lit(False)), "Unknown")
        .when(above.isNull(), "EnclaveGranted").when(same & own["is_inherited"], "InheritedSame")
        .when(same, "ExplicitBoundary").otherwise("PermissionChanged")
    )
    severed = F.struct(F.lit("None").alias("level"), F.lit("InheritanceSevered").alias("change_type"))
    return F.when(own.isNotNull(), F.struct(own["level"].alias("level"), change.alias("change_type"))).when(
        above.isNotNull() & F.coalesce("_parent_open", F.lit(False)), severed)


def counts_by_class(
    folders: DataFrame, aces: DataFrame, identity_tokens: DataFrame, accounts: DataFrame
) -> DataFrame:
    """``report_counts`` of ``change_points`` of every account, without a row per account and folder.

    Accounts whose groups are spoken about by the same entries are one class, and what
    a class can reach is worked out once. An account differs from its class only where an
    entry names itself, in those folders and those directly below: there the state of
    its class is taken off its counts and its own put in.
    """
    known = cut_lineage(known_identities(aces, identity_tokens))
    shared, own = known.where("rank > 0"), known.where("rank = 0")
    identity = F.to_json(F.array("_sid", "_account"))
    sets = shared.groupBy("target").agg(F.sha2(F.to_json(F.array_sort(F.collect_set(identity))), 256).alias("class"))
    members = cut_lineage(
        accounts.select("target").distinct().join(sets, "target", "left").withColumn("class", F.coalesce("class", F.lit("")))
    )
    heads = members.groupBy("class").agg(F.min("target").alias("target"))
    of_class = shared.join(heads, "target").drop("target").withColumnRenamed("class", "target")
    class_codes = cut_lineage(_first_entries(entries_of(aces, of_class)))
    class_state = cut_lineage(_decided(class_codes).withColumnRenamed("target", "class"))

    open_to = class_state.where("state is not null").select(F.col("class").alias("target"), "path_key", "state.*")
    texts = [F.lit(None).cast("string").alias(c) for c in ("grant_source", "grant_trace")]
    access = open_to.select("target", "path_key", "level", "allowed", F.lit(0).alias("denied"), F.lit(False).alias("has_deny"), "is_inherited", *texts)
    none = accounts.where(F.lit(False))
    by_class = report_counts(change_points(access, folders, none)).withColumnRenamed("target", "class")

    # Where entries name the account itself: the first entry of each bit is the earlier of its own and its class's.
    mine = _first_entries(entries_of(aces, own)).join(members, "target")
    theirs = class_codes.select(F.col("target").alias("class"), "path_key", *[F.col(b).alias(f"_c{b}") for b in _BITS])
    both = measured_join(mine, theirs, ["class", "path_key"], "left")
    named = cut_lineage(_decided(both.select("target", "class", "path_key", *[F.least(b, f"_c{b}").alias(b) for b in _BITS])))

    place = folders.where("readable").select("path_key", "parent_key", "depth")
    parents = folders.groupBy(F.col("path_key").alias("parent_key")).agg(
        F.max(~F.col("readable")).alias("_parent_closed"), F.max("readable").alias("_parent_open"))
    at = named.select("target", "class", "path_key")
    # Folder rows an own entry bears on: in the folder itself, or, where that has none, in its parent.
    inside = at.join(place, "path_key").select("target", "class", "path_key", "parent_key", "depth")
    below = measured_join(place, at.withColumnRenamed("path_key", "parent_key"), ["parent_key"]).select(*inside.columns)
    touched = inside.unionByName(below.join(at.select("target", "path_key"), ["target", "path_key"], "left_anti"))
    rows = measured_join(touched, parents, ["parent_key"], "left")
    for key, name in (("path_key", "own"), ("parent_key", "above")):
        held = class_state.select("class", F.col("path_key").alias(key), F.col("state").alias(f"_{name}_class"))
        self = named.select("target", F.col("path_key").alias(key), F.col("state").alias(f"_{name}_self"), F.lit(True).alias(f"_{name}_named"))
        rows = measured_join(measured_join(rows, held, ["class", key], "left"), self, ["target", key], "left")
        chosen = F.when(F.col(f"_{name}_named"), F.col(f"_{name}_self")).otherwise(F.col(f"_{name}_class"))
        rows = rows.withColumn(f"_{name}", chosen)
    pair = rows.select("target", F.explode(F.array(
        F.struct(F.lit(-1).alias("sign"), _kind(F.col("_own_class"), F.col("_above_class")).alias("item")),
        F.struct(F.lit(1).alias("sign"), _kind(F.col("_own"), F.col("_above")).alias("item")),
    )).alias("_p")).select("target", "_p.sign", "_p.item.*").where("change_type is not null")
    changed = report_counts(pair.withColumn("target", F.struct("target", "sign"))).select(
        "target.target", *[(F.col(c) * F.col("target.sign")).alias(c) for c in _COUNTS])

    closed = folders.where(~F.col("readable")).groupBy("root_key").agg(F.count("*").alias("unavailable"))
    shut = accounts.select("target", "root_key").distinct().join(closed, "root_key")
    shut = shut.select("target", *[F.col(c) if c == "unavailable" else F.lit(0).cast("long").alias(c) for c in _COUNTS])
    plain = measured_join(members, by_class, ["class"]).select("target", *_COUNTS)
    total = plain.unionByName(changed).unionByName(shut).groupBy("target").agg(*[F.sum(c).alias(c) for c in _COUNTS])
    return total.where(F.col("accessible") + F.col("severed") + F.col("unavailable") > 0)


def rights_union(aces: DataFrame) -> DataFrame:
    """All bits an identity is allowed or denied per folder, whatever the order."""
    union = lambda kind: F.coalesce(F.bit_or(F.when(F.col("access_type") == kind, F.col("rights"))), F.lit(0))
    return aces.groupBy("path_key", "sid").agg(union("Allow").alias("allow_bits"), union("Deny").alias("deny_bits"))


def item_filter(text: str = "", changes_only: bool = False) -> Column:
    keep = ~F.col("change_type").isin("InheritedSame", "Baseline") if changes_only else F.lit(True)
    if text.strip():
        needle, hit = F.lit(text.strip().lower()), F.lit(False)
        for column in ("folder_name", "path_key", "grant_source", "level", "change_type"):
            hit = hit | F.contains(F.lower(F.coalesce(column, F.lit(""))), needle)
        keep = keep & hit
    return keep


# --- access lists as tables ------------------------------------------------

def flatten_acl(folders: DataFrame, aces: DataFrame, max_depth: int = 2, reparse: DataFrame | None = None) -> DataFrame:
    """One row per folder and entry down to a depth; an unreadable folder gives one marker row."""
    scope = folders.where(F.col("depth") <= max_depth)
    if reparse is not None:
        scope = scope.join(reparse.select("path_key").distinct(), "path_key", "left_anti")
    readable = scope.where("readable").select("path_key", "folder_name", "depth", "protected").join(aces, "path_key", "left")
    entries = readable.select(
        "path_key", "folder_name", "depth", "protected", "ace_order", "sid", "account", "rights", "access_type",
        "is_inherited", "inherit_flags", "prop_flags",
    )
    marker = scope.where(~F.col("readable")).select(
        "path_key", "folder_name", "depth", "protected", F.lit(0).alias("ace_order"), F.lit("").alias("sid"),
        F.lit(MARKER).alias("account"), F.lit(0).alias("rights"), F.lit("Error").alias("access_type"),
        F.lit(False).alias("is_inherited"), F.lit(0).alias("inherit_flags"), F.lit(0).alias("prop_flags"),
    )
    return entries.unionByName(marker)


def acl_history(snapshots: DataFrame, folder_key: str | None = None) -> DataFrame:
    """Access-list snapshots, one per id, newest first; of one folder or of all."""
    wanted = snapshots if folder_key is None else snapshots.where(F.col("path_key") == folder_key)
    rest = [c for c in wanted.columns if c not in ("snapshot_id", "path_key")]
    once = wanted.groupBy("path_key", "snapshot_id").agg(F.min(F.struct(*rest)).alias("_row"))
    return once.select("snapshot_id", "path_key", "_row.*").orderBy("path_key", F.desc("ts"))
