"""Secret scans: fixed patterns, and a battery of randomness tests under false-discovery control (SQL functions only).

Spans are code-point offsets, end exclusive. Three fixed kinds come from patterns (``assign``, ``access``, ``hex``). The
fourth, ``random``, comes from the battery: every run of 20 or more ``[A-Za-z0-9+/_-]`` with a digit or a change from
lower to upper case, that overlaps no fixed span, is a candidate. Its encoding is inferred from its characters (hex,
base32, base62 or base64); over that alphabet's code values three tests of randomness are made:

* chi-squared uniformity: K/n * sum(count^2) - n against its mean and variance under a uniform alphabet of K;
* runs above and below the alphabet's middle (Wald-Wolfowitz);
* serial correlation at lag 1.

Each is held against two hypotheses. Under randomness, the smallest of the three p-values, times three, must be
``LEAST_RANDOM`` or more: the token may be random. Under ordinary text, which is what a discovery has to refute,

* two characters are equal with the chance ``MATCH`` of the encoding, so chi-squared is noncentral, and a low one speaks
  against text;
* the class of character (lower, upper, digit, other) changes at ``TEXT_CHANGE`` of the places, so many runs of classes
  speak against text (Chernoff's bound);
* neighbours' codes correlate by ``TEXT_SERIAL``, as classes cluster, so a low correlation speaks against text.

Runs and correlation both look at the order of characters: their evidence is twice the lesser p-value. Chi-squared looks
at the counts only; Fisher's method combines it with the order's into the token's p-value of being text.
Benjamini-Hochberg at ``FDR`` runs over these within bands of length, since short tokens are many and weak evidence and
mustn't dilute long ones. P-values are binned on a log scale and rounded up, so that the procedure needs the counts of
some hundred bins rather than a sort of all candidates. All values take time in proportion to a token's length.

Cases: a null text is taken as empty; repeated rows are scanned each by itself; an empty table gives an empty result;
columns besides doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessel.session import settle, table

ASSIGN = (
    r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"""
    r"""|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
RUN = r"[A-Za-z0-9+/_-]"
MIXED = r"[0-9]|[a-z][A-Z]"
TOKEN = rf"(?<!{RUN})(?={RUN}*(?:{MIXED})){RUN}{{20,}}"
KINDS = ("assign", "access", "hex", "random")
LEAST_RANDOM, TEXT_CHANGE, TEXT_SERIAL, FDR = 0.01, 0.2, 0.2, 0.05
#: Chance that two characters of ordinary text are equal: digits for hex, letters of one case, letters of mixed case.
MATCH = {"hex": 0.1, "HEX": 0.1, "base32": 0.065, "base62": 0.055, "base64": 0.055}
#: Length bands end below these.
BANDS = (32, 48, 96)
#: Alphabets in order of their code values.
HEX_LOWER, HEX_UPPER = "0123456789abcdef", "0123456789ABCDEF"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"

CHUNK = 256
SPAN = "array<struct<start:bigint,end:bigint,token:string>>"


def _lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def spans_of(text: str, pattern: str, group: int = 0) -> Column:
    """All leftmost non-overlapping matches of ``pattern`` with their places, and the text of ``group``.

    The text split at the matches gives what lies between them, so places are running sums of both lengths. Appending copies
    what is there, so matches are taken ``CHUNK`` at a time, and chunks put together at the end.
    """
    p = _lit(pattern)
    chunk = f"""aggregate(c, struct(a.at AS at, cast(array() AS {SPAN}) AS spans),
        (b, m) -> struct(b.at + length(m.`0`) + length(m.`1`) AS at, array_append(b.spans, named_struct(
          'start', b.at + length(m.`0`), 'end', b.at + length(m.`0`) + length(m.`1`), 'token', m.`2`)) AS spans))"""
    return F.expr(
        f"""CASE WHEN rlike({text}, {p}) THEN transform(array(
              arrays_zip(slice(split({text}, {p}, -1), 1, regexp_count({text}, {p})),
                         regexp_extract_all({text}, {p}, 0), regexp_extract_all({text}, {p}, {group}))),
              all -> aggregate(transform(sequence(0, (size(all) - 1) div {CHUNK}), i -> slice(all, i * {CHUNK} + 1, {CHUNK})),
                struct(0L AS at, cast(array() AS array<{SPAN}>) AS parts),
                (a, c) -> transform(array({chunk}), x -> struct(x.at AS at, array_append(a.parts, x.spans) AS parts))[0],
                a -> flatten(a.parts)))[0] ELSE cast(array() AS {SPAN}) END"""
    ).cast(SPAN)


def _q(z: str) -> str:
    """Upper tail of the normal distribution, logistic approximation with a cubic term."""
    z = f"least(20.0D, greatest(-20.0D, {z}))"
    return f"(1.0D / (1.0D + exp(1.5976D * {z} + 0.070565D * pow({z}, 3.0D))))"


def _by_encoding(of: str, values: dict[str, object]) -> str:
    return f"CASE {of} " + " ".join(f"WHEN '{e}' THEN {v}" for e, v in values.items()) + " END"


SIZES = {"hex": 16, "HEX": 16, "base32": 32, "base62": 62, "base64": 64}
ALPHABET = _by_encoding("x.encoding", {"hex": f"'{HEX_LOWER}'", "HEX": f"'{HEX_UPPER}'", "base32": f"'{BASE32}'", "base62": f"'{BASE64}'", "base64": f"'{BASE64}'"})
#: Places between characters of different classes.
CHANGES = r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])"
_PAIRS = "zip_with(slice(x.codes, 1, x.n - 1), slice(x.codes, 2, x.n - 1), (a, b) -> {})"
#: Named values of the battery by stage; a stage may use those before it (as fields of x).
STAGES = (
    {"k": _by_encoding("x.encoding", SIZES), "n": "length(x.token)", "plain": "translate(x.token, '-_', '+/')", "match": _by_encoding("x.encoding", {e: f"{m}D" for e, m in MATCH.items()})},
    {
        "codes": f"transform(split(x.plain, ''), c -> instr({ALPHABET}, c) - 1)",
        "squares": f"aggregate(split({ALPHABET}, ''), 0L, (a, c) -> a + cast(pow(x.n - length(replace(x.plain, c, '')), 2) AS bigint))",
        "rate": f"regexp_count(x.plain, {_lit(CHANGES)}) / cast(x.n - 1 AS double)",
    },
    {
        "high": "size(filter(x.codes, c -> 2 * c >= x.k))",
        "runs": f"1 + size(filter({_PAIRS.format('(2 * a >= x.k) <> (2 * b >= x.k)')}, d -> d))",
        "mean": "aggregate(x.codes, 0L, (a, c) -> a + c) / cast(x.n AS double)",
        "chi": "cast(x.k AS double) / x.n * x.squares - x.n",
        "off": "x.k * x.match - 1.0D",
    },
    {
        "ss": "aggregate(x.codes, 0.0D, (a, c) -> a + (c - x.mean) * (c - x.mean))",
        "lag": f"aggregate({_PAIRS.format('(b - x.mean) * (a - x.mean)')}, 0.0D, (a, d) -> a + d)",
        "mu": "2.0D * x.high * (x.n - x.high) / x.n + 1.0D",
    },
    {
        "z_chi": "(x.chi - (x.k - 1)) / sqrt(2.0D * (x.k - 1) * (1.0D - 1.0D / x.n))",
        "z_runs": "CASE WHEN x.mu <= 2.0D THEN 0.0D ELSE abs(x.runs - x.mu) / sqrt((x.mu - 1.0D) * (x.mu - 2.0D) / (x.n - 1)) END",
        "z_serial": "CASE WHEN x.ss = 0.0D THEN sqrt(cast(x.n AS double)) ELSE abs(x.lag / x.ss + 1.0D / x.n) * sqrt(cast(x.n AS double)) END",
        "t_chi": "(x.chi - (x.k - 1) - x.n * x.off) / sqrt(2.0D * (x.k - 1) + 4.0D * x.n * x.off)",
        "t_serial": f"CASE WHEN x.ss = 0.0D THEN 20.0D ELSE (x.lag / x.ss - {TEXT_SERIAL}D) * sqrt(cast(x.n AS double)) END",
        "p_runs": f"CASE WHEN x.rate <= {TEXT_CHANGE}D THEN 1.0D WHEN x.rate >= 1.0D THEN exp((x.n - 1) * ln({TEXT_CHANGE}D)) ELSE exp(-(x.n - 1) * (x.rate * ln(x.rate / {TEXT_CHANGE}D) + (1.0D - x.rate) * ln((1.0D - x.rate) / (1.0D - {TEXT_CHANGE}D)))) END",
    },
    {
        "p_random": f"least(1.0D, 3.0D * least({_q('x.z_chi')}, 2.0D * {_q('x.z_runs')}, 2.0D * {_q('x.z_serial')}))",
        "q": f"greatest({_q('-x.t_chi')} * least(1.0D, 2.0D * least(x.p_runs, {_q('-x.t_serial')})), 1e-300D)",
    },
    {"p_text": "x.q * (1.0D - ln(x.q))"},
    {
        "band": "CASE " + " ".join(f"WHEN x.n < {b} THEN {i}" for i, b in enumerate(BANDS)) + f" ELSE {len(BANDS)} END",
        "bin": "cast(floor(-10.0D * ln(greatest(x.p_text, 1e-300D))) AS int)",
    },
)
ENCODING = "CASE WHEN rlike(x.token, '^[0-9a-f]+$') THEN 'hex' WHEN rlike(x.token, '^[0-9A-F]+$') THEN 'HEX' WHEN rlike(x.token, '^[A-Z2-7]+$') THEN 'base32' WHEN rlike(x.token, '^[A-Za-z0-9]+$') THEN 'base62' ELSE 'base64' END"


def battery(tokens: str) -> Column:
    """An array of struct(start, end, token), by SQL, to one that adds the battery's values."""
    have = ["start", "end", "token"]
    out = tokens
    for stage in ({"encoding": ENCODING}, *STAGES):
        fields = ", ".join([f"'{f}', x.{f}" for f in have] + [f"'{f}', {sql}" for f, sql in stage.items()])
        out = f"transform({out}, x -> named_struct({fields}))"
        have += stage
    keep = ("start", "end", "token", "encoding", "p_random", "p_text", "band", "bin")
    return F.expr(f"transform({out}, x -> named_struct({', '.join(f"'{f}', x.{f}" for f in keep)}))")


def thresholds(candidates: DataFrame, fdr: float = FDR) -> dict[int, int]:
    """``candidates(band, bin)`` to the least bin found, by band of length: Benjamini-Hochberg on bins.

    What comes to the driver is a number for each band.
    """
    counts = candidates.groupBy("band", "bin").count()
    whole = W.partitionBy("band")
    above = F.sum("count").over(whole.orderBy(F.desc("bin")))
    bound = F.exp(-F.col("bin") / 10.0) <= fdr * above / F.sum("count").over(whole)
    best = counts.withColumn("ok", bound).filter("ok").groupBy("band").agg(F.min("bin").alias("bin"))
    return {r["band"]: r["bin"] for r in best.collect()}


def scan_secrets(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans for each row of ``docs``."""
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id",
        F.filter(spans_of("text", ASSIGN, 2), lambda s: F.length(s["token"]) >= 6).alias("assign"),
        spans_of("text", ACCESS).alias("access"), spans_of("text", HEX).alias("hex"), spans_of("text", TOKEN).alias("tokens"),
    )
    clear = F.filter("tokens", lambda t: ~F.exists(F.concat("assign", "access", "hex"), lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    found = settle(found.withColumn("tokens", clear).withColumn("tokens", battery("tokens")), "secrets")  # the texts are read once
    least = thresholds(found.select(F.explode("tokens").alias("t")).select("t.band", "t.bin"), fdr)
    keep = F.filter("tokens", lambda t: (t["p_random"] >= LEAST_RANDOM) & _reached(t, least))
    found = found.withColumn("random", F.transform(keep, lambda t: F.struct(t["start"], t["end"], t["token"])))

    def rows(*kinds: str) -> Column:
        each = [F.expr(f"transform({k}, s -> named_struct('start', s.start, 'k', {KINDS.index(k)}, 'end', s.end))") for k in kinds]
        name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["k"] + 1)
        return F.array_join(F.transform(F.array_sort(F.concat(*each)), lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")

    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(rows(*KINDS[:3]), 256).alias("base_sha256"), rows(*KINDS).alias("spans")
    )


def _reached(t: Column, least: dict[int, int]) -> Column:
    cut = F.lit(1 << 30)
    for band, b in least.items():
        cut = F.when(t["band"] == band, b).otherwise(cut)
    return t["bin"] >= cut


def _duck_spans(pattern: str, kind: int, keep: str = "true", group: int = 0) -> str:
    p = "'" + pattern.replace("'", "''") + "'"
    return f"""SELECT r, doc_id, {kind} AS k, s, s + length(m) AS e, g AS token FROM (
      SELECT r, doc_id, gs[i] AS g, ms[i] AS m, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS s FROM (
        SELECT r, doc_id, string_split_regex(text, {p}) AS gaps, regexp_extract_all(text, {p}, 0) AS ms, regexp_extract_all(text, {p}, {group}) AS gs, unnest(generate_series(1, len(regexp_extract_all(text, {p}, 0)))) AS i
        FROM d WHERE regexp_matches(text, {p}))) WHERE {keep.replace('token', 'g')}"""


_Z = "least(20.0, greatest(-20.0, {z}))::DOUBLE"
_P = lambda z: f"(1.0 / (1.0 + exp(1.5976 * {_Z.format(z=z)} + 0.070565 * pow({_Z.format(z=z)}, 3))))"
#: DuckDB SQL of ``scan_secrets``.
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
base AS (
  {_duck_spans(ASSIGN, 0, "length(token) >= 6", 2)}
  UNION ALL {_duck_spans(ACCESS, 1)}
  UNION ALL {_duck_spans(HEX, 2)}),
tok AS (SELECT * FROM ({_duck_spans(RUN + "{20,}", 3, f"regexp_matches(token, '{MIXED}')")}) t
        WHERE NOT EXISTS (FROM base b WHERE b.r = t.r AND b.s < t.e AND t.s < b.e)),
v1 AS (SELECT *, CASE WHEN regexp_matches(token, '^[0-9a-f]+$') THEN 'hex' WHEN regexp_matches(token, '^[0-9A-F]+$') THEN 'HEX' WHEN regexp_matches(token, '^[A-Z2-7]+$') THEN 'base32' WHEN regexp_matches(token, '^[A-Za-z0-9]+$') THEN 'base62' ELSE 'base64' END AS enc, length(token) AS n FROM tok),
v2 AS (SELECT *, {_by_encoding("enc", SIZES)} AS kk, ({_by_encoding("enc", MATCH)})::DOUBLE AS match,
  list_transform(generate_series(1, n), lambda i: instr(CASE enc WHEN 'hex' THEN '{HEX_LOWER}' WHEN 'HEX' THEN '{HEX_UPPER}' WHEN 'base32' THEN '{BASE32}' ELSE '{BASE64}' END, translate(token[i], '-_', '+/')) - 1) AS codes,
  list_transform(generate_series(1, n), lambda i: CASE WHEN token[i] BETWEEN 'a' AND 'z' THEN 1 WHEN token[i] BETWEEN 'A' AND 'Z' THEN 2 WHEN token[i] BETWEEN '0' AND '9' THEN 3 ELSE 4 END) AS cls FROM v1),
v3 AS (SELECT *, list_sum(list_transform(list_distinct(codes), lambda c: len(list_filter(codes, lambda x: x = c)) ** 2)) AS squares,
  len(list_filter(codes, lambda c: 2 * c >= kk)) AS high,
  1 + len(list_filter(generate_series(2, n), lambda i: (2 * codes[i] >= kk) <> (2 * codes[i - 1] >= kk))) AS runs,
  len(list_filter(generate_series(2, n), lambda i: cls[i] <> cls[i - 1])) / (n - 1)::DOUBLE AS rate, list_sum(codes) / n::DOUBLE AS mean FROM v2),
v4 AS (SELECT *, list_sum(list_transform(codes, lambda c: (c - mean) * (c - mean))) AS ss,
  list_sum(list_transform(generate_series(2, n), lambda i: (codes[i] - mean) * (codes[i - 1] - mean))) AS lag, 2.0::DOUBLE * high * (n - high) / n + 1.0 AS mu FROM v3),
v5 AS (SELECT *, (kk::DOUBLE / n * squares - n - (kk - 1)) / sqrt(2.0::DOUBLE * (kk - 1) * (1.0 - 1.0::DOUBLE / n)) AS z1,
  CASE WHEN mu <= 2.0 THEN 0.0 ELSE abs(runs - mu) / sqrt((mu - 1.0) * (mu - 2.0) / (n - 1)) END::DOUBLE AS z2,
  CASE WHEN ss = 0.0 THEN sqrt(n::DOUBLE) ELSE abs(lag / ss + 1.0 / n::DOUBLE) * sqrt(n::DOUBLE) END AS z3,
  (kk::DOUBLE / n * squares - n - (kk - 1) - n * (kk * match - 1.0)) / sqrt(2.0::DOUBLE * (kk - 1) + 4.0 * n * (kk * match - 1.0)) AS t1,
  CASE WHEN ss = 0.0 THEN 20.0 ELSE (lag / ss - {TEXT_SERIAL}) * sqrt(n::DOUBLE) END::DOUBLE AS t3,
  CASE WHEN rate <= {TEXT_CHANGE} THEN 1.0 WHEN rate >= 1.0 THEN exp((n - 1) * ln({TEXT_CHANGE}::DOUBLE)) ELSE exp(-(n - 1) * (rate * ln(rate / {TEXT_CHANGE}::DOUBLE) + (1.0 - rate) * ln((1.0 - rate) / (1.0 - {TEXT_CHANGE}::DOUBLE)))) END::DOUBLE AS p_runs FROM v4),
v6 AS (SELECT *, least(1.0, 3.0 * least({_P("z1")}, 2.0 * {_P("z2")}, 2.0 * {_P("z3")})) AS p_random,
  greatest({_P("-t1")} * least(1.0, 2.0 * least(p_runs, {_P("-t3")})), 1e-300)::DOUBLE AS q,
  CASE {" ".join(f"WHEN n < {b} THEN {i}" for i, b in enumerate(BANDS))} ELSE {len(BANDS)} END AS band FROM v5),
v7 AS (SELECT *, floor(-10.0 * ln(greatest(q * (1.0 - ln(q)), 1e-300)))::INT AS bin FROM v6),
c AS (SELECT band, bin, count(*) AS n FROM v7 GROUP BY ALL),
bh AS (SELECT band, min(bin) AS least FROM (SELECT band, bin, exp(-bin / 10.0) <= {FDR} * sum(n) OVER (PARTITION BY band ORDER BY bin DESC) / sum(n) OVER (PARTITION BY band) AS ok FROM c) WHERE ok GROUP BY band),
spans AS (SELECT r, k, s, e FROM base UNION ALL SELECT r, k, s, e FROM v7 JOIN bh USING (band) WHERE bin >= least AND p_random >= {LEAST_RANDOM}),
g AS (SELECT r, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex, count(*) FILTER (WHERE k = 3) AS n_random,
  string_agg((['assign', 'access', 'hex', 'random'])[k + 1] || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, k) FILTER (WHERE k < 3) AS b,
  string_agg((['assign', 'access', 'hex', 'random'])[k + 1] || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, k) AS spans FROM spans GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_random, 0) AS n_random,
  sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)
"""


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: the spans of all ``documents``."""
    return scan_secrets(table(spark, sf_dir, "documents"))
