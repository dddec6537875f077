"""Secret scans: patterns for single secrets, and links between the parts of a credential.

Strong patterns (assignments, access keys, long hexadecimal runs) are reported
wherever they stand. Weak candidates - an identifier, a random-looking token, an
endpoint - are common in harmless text; one is reported only if a part that
completes it lies within its scope, ``scope`` code points before or after: an
identifier needs a secret, a token an identifier or an endpoint, an endpoint a
secret. Strong spans count as parts too.

Spans come from splitting the text at the matches of a pattern and adding up
the lengths of what lies between. Parts meet by document and by cell of
``scope`` code points, so a document with many parts is joined in cells that
hold a few each, never all with all.

Null text is empty. Rows of one doc_id and text count once each but share one
set of spans. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from girder.session import settle

SCOPE = 200


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEYWORDS = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + either_case("api") + "_?" + either_case("key")

# Kind, pattern whose first group is the value, least length of that value. In the order of the report.
STRONG = (
    ("assign", rf"""(?:{KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
    ("access", "(AKIA[A-Z0-9]+)", 20),
    ("hex", "([0-9a-f]{24,})", 24),
)
WEAK = (
    ("id", "([A-Z0-9]{12,})", 12),
    ("secret", "([A-Za-z0-9+/_=-]{20,})", 20),
    ("endpoint", r"""((?:https?|ftp|s3|gs|wss?|amqp|redis|postgres|postgresql|mysql|mongodb)://[^\x00-\x20"'<>]+|@[a-z0-9-]+(?:\.[a-z0-9-]+)+)""", 8),
)
KINDS = [k for k, _, _ in STRONG + WEAK]
ROLES = {"assign": "secret", "access": "id", "hex": "secret", "id": "id", "secret": "secret", "endpoint": "endpoint"}
# Roles of which one has to be near.
NEEDS = {"id": ("secret",), "secret": ("id", "endpoint"), "endpoint": ("secret",)}


def _matches(text: Column, number: int, pattern: str) -> Column:
    """Kind number, lengths between matches, lengths of matches, values; null arrays where nothing matches."""
    found = text.rlike(pattern)
    return F.struct(
        F.lit(number).alias("kind"),
        F.when(found, F.transform(F.split(text, pattern, -1), F.length)).alias("gaps"),
        F.when(found, F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)).alias("sizes"),
        F.when(found, F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).alias("found"),
    )


def _row_keys() -> list[Column]:
    return [F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", "doc_id", F.lit(1)).alias("k2")]


def parts(docs: DataFrame) -> DataFrame:
    """(k1, k2, kind, start, end) of all strong spans and weak candidates; k1 and k2 stand for the row."""
    text = F.coalesce("text", F.lit(""))
    listed = F.array(*[_matches(text, i, pattern) for i, (_, pattern, _) in enumerate(STRONG + WEAK)])
    rows = docs.select(*_row_keys(), F.explode(listed).alias("m")).where("m.gaps is not null").select("k1", "k2", "m.*").distinct()
    # Running sums of gaps and matches give the places.
    each = rows.select(
        "k1", "k2", "kind", F.posexplode(F.arrays_zip("gaps", "sizes", "found")).alias("at", "x")
    ).where("x.sizes is not null")
    upto = Window.partitionBy("k1", "k2", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("x.gaps") + F.col("x.sizes")).over(upto)
    placed = each.select("k1", "k2", "kind", end.alias("end"), F.col("x.sizes").alias("size"), F.col("x.found").alias("value"))
    least = F.element_at(F.array(*[F.lit(n) for _, _, n in STRONG + WEAK]), F.col("kind") + 1)
    mixed = F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")
    short_id = (F.col("kind") != KINDS.index("id")) | (F.length("value") <= 32)
    loose = F.col("kind").isin(KINDS.index("id"), KINDS.index("secret"))
    kept = placed.where((F.length("value") >= least) & (~loose | (mixed & short_id)))
    return kept.select("k1", "k2", "kind", (F.col("end") - F.col("size")).cast("long").alias("start"), F.col("end").cast("long"))


def _cells(start: Column, end: Column, scope: int) -> Column:
    return F.explode(F.sequence(F.floor(start / scope), F.floor(end / scope)))


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak candidates of ``found`` that overlap no strong span and have a complementary part in scope."""
    strong = F.col("kind") < len(STRONG)
    role = F.element_at(F.array(*[F.lit(ROLES[k]) for k in KINDS]), F.col("kind") + 1)
    spread = found.select("k1", "k2", "kind", "start", "end", role.alias("role"), _cells(F.col("start"), F.col("end"), scope).alias("cell"))
    other = [F.col(c).alias(f"other_{c}") for c in ("kind", "start", "end", "role")]
    covers = spread.where(strong).select("k1", "k2", "cell", *other)
    key = ["k1", "k2", "kind", "start", "end"]
    overlap = (F.col("other_start") < F.col("end")) & (F.col("start") < F.col("other_end"))
    hidden = spread.where(~strong).join(covers, ["k1", "k2", "cell"]).where(overlap).select(*key).distinct()
    open_parts = found.join(hidden, key, "left_anti")
    roles = open_parts.withColumn("role", role)
    reach = roles.where(~strong).withColumn("cell", _cells(F.greatest(F.col("start") - scope, F.lit(0)), F.col("end") + scope, scope))
    near = roles.withColumn("cell", _cells(F.col("start"), F.col("end"), scope)).select("k1", "k2", "cell", *other)
    wanted = F.lit(False)
    for own, others in NEEDS.items():
        wanted = wanted | ((F.col("role") == own) & F.col("other_role").isin(*others))
    gap = F.greatest(F.col("other_start") - F.col("end"), F.col("start") - F.col("other_end"))
    apart = F.col("start") != F.col("other_start")
    return reach.join(near, ["k1", "k2", "cell"]).where(wanted & apart & (gap <= scope)).select(*key).distinct()


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id with ``base`` and ``spans``: sorted arrays of (start, kind, end), without and with the linked candidates."""
    found = settle(parts(docs))
    base = found.where(F.col("kind") < len(STRONG))
    span = F.struct("start", "kind", "end")
    per_row = (
        base.unionByName(linked(found, scope))
        .groupBy("k1", "k2")
        .agg(F.sort_array(F.collect_set(span)).alias("spans"))
        .withColumn("base", F.filter("spans", lambda s: s["kind"] < len(STRONG)))
    )
    none = F.array().cast("array<struct<start: bigint, kind: int, end: bigint>>")
    return (
        docs.select("doc_id", *_row_keys())
        .join(per_row, ["k1", "k2"], "left")
        .select("doc_id", F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"))
    )


def listing(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
