"""Secret scans with linked parts, with DataFrame operations only.

``find_secrets`` finds every kind's spans in whole texts (``split`` and ``regexp_extract_all`` give the
pieces around and the matches themselves; their running length is a span's place) and then links
parts of multipart credentials: access identifiers, secrets and endpoints are joined by
overlapping intervals, each part's scope being ``scope`` code points on either side within its text.

Reported always: ``assign``, ``access``, ``hex`` (the base kinds). Reported only when complementary parts
co-occur in scope: ``account`` (a user or account name), with a secret; ``opaque`` (a long mixed token),
with an identifier; ``endpoint`` (a URL with a host), with an identifier and a secret. Identifiers are
access and account; secrets are assign, hex and opaque. An opaque token that overlaps a base span is
that span, not a part of its own.

The join meets in bins of ``scope`` code points of one text. Spans of a kind don't overlap and each has
a least length, so a bin holds a bounded number of them and the join's rows grow with the spans.

Defined results: a null text counts as empty (no spans); repeated rows each get their spans; an
empty table gives an empty result; other columns pass through unless named like a result column.
Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import bound, staged, text_or_empty

# The base kinds, in order, with their patterns and least lengths.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
# A run that's too short can be left out of these two patterns: no part of it can match either.
ACCESS = f"AKIA[A-Z0-9]{{{ACCESS_LEAST - 4},}}"
HEX = f"[0-9a-f]{{{HEX_LEAST},}}"
BASE = ("assign", "access", "hex")

# The weak kinds. An opaque token is kept if it has a digit, a capital and a small letter.
ACCOUNT = r"""(?i:user|username|login|account|client_id|account_id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]+"""
OPAQUE = r"[A-Za-z0-9+/_-]{24,}"
ENDPOINT = r"""(?i:https?)://[A-Za-z0-9.-]+[A-Za-z0-9][^\x20\t\r\n"'<>]*"""
WEAK = ("account", "opaque", "endpoint")
RESULT = ("n_assign", "n_access", "n_hex", "base_sha256", "spans")
SPAN = "array<struct<start:int,kind:int,end:int>>"
#: Matches whose places are summed at a time: a list that grows within a fold is copied at each step.
BLOCK = 256


def _spans(text: Column, pattern: str, number: int, keep=None) -> Column:
    """The matches of ``pattern`` that ``keep`` accepts, as structs (start, number of the kind, end).

    A match starts after all pieces and matches before it. These are summed within blocks of matches, then
    over the blocks, so a text takes time in proportion to its matches.
    """
    none = F.array().cast(SPAN)
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    span = lambda a, e: F.struct(a.cast("int").alias("start"), F.lit(number).alias("kind"), e.cast("int").alias("end"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + F.char_length(x["p"])
        m = F.coalesce(x["m"], F.lit(""))
        e = a + F.char_length(m)
        kept = F.char_length(m) > 0 if keep is None else (F.char_length(m) > 0) & keep(m)
        return F.struct(e.alias("at"), F.when(kept, F.concat(acc["found"], F.array(span(a, e)))).otherwise(acc["found"]).alias("found"))

    def block(k: Column, z: Column) -> Column:
        return F.aggregate(F.slice(z, k * BLOCK + 1, F.lit(BLOCK)), F.struct(F.lit(0).alias("at"), none.alias("found")), step)

    def shifted(blocks: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("offs"))
        offs = F.aggregate(blocks, start, lambda acc, b: F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["offs"], F.array(acc["at"])).alias("offs")), lambda acc: acc["offs"])
        return F.flatten(F.zip_with(blocks, offs, lambda b, o: F.transform(b["found"], lambda s: span(s["start"] + o, s["end"] + o))))

    blocks = bound(zipped, lambda z: F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / BLOCK).cast("int")), lambda k: block(k, z)))
    return F.when(text.rlike(pattern), bound(blocks, shifted)).otherwise(none)


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in BASE + WEAK))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 200, columns: list[str] | None = None) -> DataFrame:
    """``docs`` with the counts of the base kinds, the digest of their spans, and all spans; ``columns``: those of ``docs`` to carry (all).

    Texts are searched once: what was found is written to the shared folder with the columns to carry, and the
    parts are linked from there.
    """
    docs = docs.drop(*RESULT)
    names = docs.columns if columns is None else columns
    text = text_or_empty(F.col(text_col))
    mixed = lambda m: m.rlike("[0-9]") & m.rlike("[A-Z]") & m.rlike("[a-z]")
    found = docs.withColumns({
        "_se_a": _spans(text, ASSIGN, 0, lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_LEAST),
        "_se_i": _spans(text, ACCESS, 1),
        "_se_h": _spans(text, HEX, 2),
        "_se_u": _spans(text, ACCOUNT, 3),
        "_se_o": _spans(text, OPAQUE, 4, mixed),
        "_se_e": _spans(text, ENDPOINT, 5),
    })
    # a text's spans depend on the text alone; the id keeps equal texts apart, so that copies don't make a hot key
    linkable = (
        ((F.size("_se_i") > 0) & (F.size("_se_o") > 0))
        | ((F.size("_se_u") > 0) & (F.size("_se_a") + F.size("_se_h") + F.size("_se_o") > 0))
        | ((F.size("_se_e") > 0) & (F.size("_se_i") > 0) & (F.size("_se_a") + F.size("_se_h") > 0))
    )
    found = found.withColumn("_se_k", F.when(linkable, F.sha2(text, 256)))
    found = found.withColumn("_se_b", F.array_sort(F.concat("_se_a", "_se_i", "_se_h")))
    found = staged(found.select(*dict.fromkeys([*names, id_col]), *(c for c in found.columns if c.startswith("_se_"))), "secret-parts")

    parts = found.where("_se_k is not null").select(F.col(id_col).alias("_se_d"), "_se_k", F.explode(F.concat("_se_b", "_se_u", "_se_o", "_se_e")).alias("s"))
    parts = parts.select("_se_d", "_se_k", "s.*").distinct()
    # an opaque token goes if a base span before it reaches into it or one after it starts within it
    base, own = F.col("kind") < 3, Window.partitionBy("_se_d", "_se_k")
    past = own.orderBy("start", "kind", "end").rowsBetween(Window.unboundedPreceding, -1)
    ahead = own.orderBy(F.desc("start"), F.desc("kind"), F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("reach", F.max(F.when(base, F.col("end"))).over(past)).withColumn("following", F.min(F.when(base, F.col("start"))).over(ahead))
    over = F.coalesce(F.col("reach") > F.col("start"), F.lit(False)) | F.coalesce(F.col("following") < F.col("end"), F.lit(False))
    parts = parts.where((F.col("kind") != 4) | ~over).drop("reach", "following")
    # each part meets the identifiers and secrets whose interval, widened by the scope, overlaps it
    helpers = parts.where("kind < 5").select(F.col("_se_d").alias("d"), F.col("_se_k").alias("k"), F.col("kind").alias("hk"), F.col("start").alias("hs"), F.col("end").alias("he"))
    helpers = helpers.withColumn("bin", F.explode(F.sequence(F.floor(F.greatest(F.col("hs") - scope, F.lit(0)) / scope), F.floor((F.col("he") + scope) / scope))))
    weak = parts.where("kind > 2").withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor(F.col("end") / scope))))
    near = (F.col("hs") - scope <= F.col("end")) & (F.col("start") <= F.col("he") + scope) & (F.col("kind") != F.col("hk"))
    linked = weak.join(helpers, F.col("_se_d").eqNullSafe(F.col("d")) & (F.col("_se_k") == F.col("k")) & (weak["bin"] == helpers["bin"]) & near)
    sides = linked.groupBy("_se_d", "_se_k", "kind", "start", "end").agg(F.max(F.col("hk").isin(1, 3)).alias("ident"), F.max(F.col("hk").isin(0, 2, 4)).alias("secret"))
    kept = sides.where("(kind = 3 and secret) or (kind = 4 and ident) or (kind = 5 and ident and secret)")
    added = kept.groupBy(F.col("_se_d").alias("_se_d2"), F.col("_se_k").alias("_se_k2")).agg(F.collect_set(F.struct("start", "kind", "end")).alias("_se_add"))

    out = found.join(added, F.col(id_col).eqNullSafe(F.col("_se_d2")) & (F.col("_se_k") == F.col("_se_k2")), "left")
    return out.select(
        *names,
        F.size("_se_a").cast("long").alias("n_assign"),
        F.size("_se_i").cast("long").alias("n_access"),
        F.size("_se_h").cast("long").alias("n_hex"),
        F.sha2(_joined(F.col("_se_b")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("_se_b", F.coalesce("_se_add", F.array().cast(SPAN))))).alias("spans"),
    )


def secrets_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_secrets(docs, columns=["doc_id"]).select("doc_id", *RESULT)


def _sql_spans(pattern: str, number: int, keep: str) -> str:
    p = pattern.replace("'", "''")
    at = "coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)"
    return f"""(SELECT list_filter(list_transform(range(1, len(m) + 1), lambda i: {{'start': ({at})::INTEGER, 'kind': {number}, 'end': ({at} + length(m[i]))::INTEGER, 'm': m[i]}}), lambda s: {keep})
        FROM (SELECT regexp_extract_all(t, '{p}') AS m, regexp_split_to_array(t, '{p}') AS p))"""


_Q = ASSIGN.replace("'", "''")
_LIST = lambda x: f"list_transform({x}, lambda s: [{{'start': s.start, 'kind': s.kind, 'end': s.end}}][1])"
_JOIN = lambda x: f"array_to_string(list_transform(list_sort({x}), lambda s: (['assign', 'access', 'hex', 'account', 'opaque', 'endpoint'])[s.kind + 1] || ':' || s.start || ':' || s.end), ',')"
_NEAR = lambda kinds: f"len(list_filter(allp, lambda h: h.kind IN ({kinds}) AND h.kind <> s.kind AND h.start - 200 <= s.end AND s.start <= h.end + 200)) > 0"

SECRETS_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT rid, doc_id,
    {_sql_spans(ASSIGN, 0, f"length(regexp_extract(s.m, '{_Q}', 2)) >= 8")} AS a,
    {_sql_spans(ACCESS, 1, "true")} AS i,
    {_sql_spans(HEX, 2, "true")} AS h,
    {_sql_spans(ACCOUNT, 3, "true")} AS u,
    {_sql_spans(OPAQUE, 4, "regexp_matches(s.m, '[0-9]') AND regexp_matches(s.m, '[A-Z]') AND regexp_matches(s.m, '[a-z]')")} AS o,
    {_sql_spans(ENDPOINT, 5, "true")} AS e FROM d),
g AS (SELECT doc_id, len(a) AS n_assign, len(i) AS n_access, len(h) AS n_hex,
    {_LIST("list_concat(a, list_concat(i, h))")} AS base, {_LIST("list_concat(u, list_concat(o, e))")} AS weak FROM f),
k AS (SELECT *, list_filter(weak, lambda s: s.kind <> 4 OR len(list_filter(base, lambda b: b.start < s.end AND s.start < b.end)) = 0) AS w FROM g),
p AS (SELECT *, list_concat(base, w) AS allp FROM k)
SELECT doc_id, n_assign, n_access, n_hex, sha256({_JOIN("base")}) AS base_sha256,
    {_JOIN(f'''list_concat(base, list_filter(w, lambda s: (s.kind = 3 AND {_NEAR("0, 2, 4")}) OR (s.kind = 4 AND {_NEAR("1, 3")}) OR (s.kind = 5 AND {_NEAR("1, 3")} AND {_NEAR("0, 2, 4")})))''')} AS spans
FROM p
"""
