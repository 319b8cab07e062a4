"""Quality rules: a threshold table compiled into one Spark projection; no user function runs.

Words are runs of characters other than blank and U+0009-U+000D. Defined cases: a null or empty text has no words and
fails `base`; every ratio with a zero denominator is 0; lines without a word are no lines; repeated rows are judged one
by one; extra columns are ignored by the query and kept by `with_quality`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A row of the threshold table: `least <= metric <= most`, judged where the text has at_words words or more."""

    name: str
    metric: str
    least: float | None = None
    most: float | None = None
    at_words: int = 0


#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is it that for was on are as with this be at by from or an have not he they which but "
    "le la les de des du et en un une que qui est pour dans par sur au pas il elle ne se ce "
    "der die das und ist von zu den mit nicht ein eine dem sich auf für als im es auch "
    "el los las del y se no con una su al lo como más pero sus"
).split()

RULES = (
    Rule("short_words", "mean_word_chars", least=2.0),
    Rule("long_words", "mean_word_chars", most=14.0),
    Rule("symbols", "symbol_ratio", most=0.1),
    Rule("few_stop_words", "stop_ratio", least=0.02, at_words=50),
    Rule("duplicate_lines", "dup_line_ratio", most=0.3),
    Rule("bullet_lines", "bullet_line_ratio", most=0.9),
    Rule("ellipsis_lines", "ellipsis_line_ratio", most=0.3),
    Rule("few_letters", "alpha_word_ratio", least=0.6),
)

#: The rules of every corpus: too few words, or more than a fifth of them in repeated five-word windows.
BASE_MIN_WORDS, BASE_MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5

_WS = r"[\x20\x09-\x0D]+"
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_RATIOS = ("mean_word_chars", "symbol_ratio", "stop_ratio", "dup_line_ratio", "bullet_line_ratio", "ellipsis_line_ratio", "alpha_word_ratio")


def _stop_set() -> str:
    """Stop words as they stand within and at the start of a sentence; one with punctuation attached isn't counted."""
    return ", ".join(f"'{w}'" for w in sorted({*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)}))


def _repeat_words() -> str:
    """Words covered by five-word windows that occur twice or more.

    `_g` holds a hash of each window. Only a text with two equal hashes sorts them; neighbours of equal hash are then
    compared word by word. A one-element array binds what a lambda reads more than once.
    """
    k = WINDOW
    same = lambda i, j: f"(s[{i}].h = s[{j}].h and slice(_w, s[{i}].i + 1, {k}) = slice(_w, s[{j}].i + 1, {k}))"
    order = "sort_array(transform(_g, (h, i) -> struct(h as h, i as i)))"
    marked = f"transform(array({order}), s -> transform(s, (e, j) -> if((j > 0 and {same('j - 1', 'j')}) or (j + 1 < size(s) and {same('j', 'j + 1')}), e.i, null)))[0]"
    places = f"sort_array(filter({marked}, i -> i is not null))"
    spans = f"transform(array({places}), p -> transform(p, (x, j) -> if(j + 1 < size(p), least({k}, p[j + 1] - x), {k})))[0]"
    total = f"aggregate({spans}, 0L, (a, x) -> a + x)"
    return f"case when size(_g) < 2 or size(array_distinct(_g)) = size(_g) then 0L else {total} end"


def with_quality(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """df with the counts, ratios, `base_failed`, `failed_rules` and `kept`; its own columns of those names are replaced."""
    own = {*_COUNTS, *_RATIOS, "base_failed", "failed_rules", "kept", "_t", "_w", "_l", "_g"}
    keep = [c for c in df.columns if c not in own or c == text]
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    one = df.select(*(F.col(f"`{c}`") for c in keep), t.alias("_t"), F.expr(f"split(trim(BOTH ' \\t\\n\\u000b\\f\\r' FROM coalesce(`{text}`, '')), '{_WS.replace(chr(92), chr(92) * 2)}')").alias("_w"))
    lines = F.expr(r"filter(split(_t, '\n'), l -> length(trim(BOTH ' \t\n\u000b\f\r' FROM l)) > 0)")
    two = one.select(
        *(F.col(f"`{c}`") for c in keep), "_t", "_w", lines.alias("_l"),
        F.expr("cast(if(_w[0] = '', 0, size(_w)) as bigint)").alias("n_words"),
    )
    named = [*(F.col(f"`{c}`") for c in keep), "_t", "_w", "_l", "n_words"]
    two = two.select(*named, F.expr("transform(_w, w -> xxhash64(w))").alias("_h"))
    window = ", ".join(f"_h[i + {j}]" for j in range(1, WINDOW))
    two = two.select(*named, F.expr(f"transform(slice(_h, 1, greatest(cast(n_words as int) - {WINDOW - 1}, 0)), (h, i) -> xxhash64(h, {window}))").alias("_g"))
    three = two.select(
        *(F.col(f"`{c}`") for c in keep), "n_words",
        F.expr("cast(length(array_join(_w, '')) as bigint)").alias("word_chars"),
        F.expr(r"cast(length(regexp_replace(_t, '[^#*$%&|<>]+', '')) as bigint)").alias("n_symbols"),
        F.expr("cast(size(_l) as bigint)").alias("_n_lines"),
        F.expr("cast(size(_l) - size(array_distinct(_l)) as bigint)").alias("n_dup_lines"),
        F.expr(_repeat_words()).alias("n_repeat_words"),
        F.expr(f"size(filter(_w, w -> w in ({_stop_set()})))").alias("_n_stop"),
        F.expr(r"size(filter(_w, w -> w rlike '\\p{L}'))").alias("_n_alpha"),
        F.expr("size(filter(_l, l -> ltrim(l) rlike '^[-*•]'))").alias("_n_bullet"),
        F.expr("size(filter(_l, l -> rtrim(l) like '%...' or rtrim(l) like '%…'))").alias("_n_ellipsis"),
    )
    ratio = lambda a, b: F.when(F.col(b) == 0, F.lit(0.0)).otherwise(F.col(a) / F.col(b))
    ratios = {
        "mean_word_chars": ratio("word_chars", "n_words"), "symbol_ratio": ratio("n_symbols", "n_words"), "stop_ratio": ratio("_n_stop", "n_words"), "dup_line_ratio": ratio("n_dup_lines", "_n_lines"),
        "bullet_line_ratio": ratio("_n_bullet", "_n_lines"), "ellipsis_line_ratio": ratio("_n_ellipsis", "_n_lines"), "alpha_word_ratio": ratio("_n_alpha", "n_words"),
    }
    four = three.select(*(F.col(f"`{c}`") for c in keep), *_COUNTS, *(v.alias(k) for k, v in ratios.items()))
    return four.select("*", *compile_rules(rules))


def compile_rules(rules: tuple[Rule, ...]) -> list[Column]:
    """The columns base_failed, failed_rules and kept."""
    base = (F.col("n_words") < BASE_MIN_WORDS) | (100 * F.col("n_repeat_words") > BASE_MAX_REPEAT_PERCENT * F.col("n_words"))
    broken = []
    for r in rules:
        bad = F.lit(False)
        if r.least is not None:
            bad |= F.col(r.metric) < r.least
        if r.most is not None:
            bad |= F.col(r.metric) > r.most
        broken.append(F.when(bad & (F.col("n_words") >= r.at_words), F.lit(r.name)))
    any_broken = F.lit(False)
    for b in broken:
        any_broken |= b.isNotNull()
    return [base.alias("base_failed"), F.filter(F.array(*broken), lambda x: x.isNotNull()).alias("failed_rules"), (~base & ~any_broken).alias("kept")]


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = with_quality(docs)
    return out.select("doc_id", *_COUNTS, "base_failed", "kept", *(F.round(c, 6).alias(c) for c in _RATIOS), F.concat_ws(",", "failed_rules").alias("failed_rules"))


def sql() -> str:
    ws = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    rules = []
    for r in RULES:
        test = " OR ".join(([f"{r.metric} < {r.least}"] if r.least is not None else []) + ([f"{r.metric} > {r.most}"] if r.most is not None else []))
        rules.append(f"CASE WHEN ({test}) AND n_words >= {r.at_words} THEN '{r.name}' END")
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda l: length(trim(l, {ws})) > 0) AS ls FROM d),
n AS (SELECT *, CAST(len(ws) AS BIGINT) AS n_words FROM w),
g AS (SELECT rid, unnest(range(1, n_words - {WINDOW - 2})) AS i, ws FROM n WHERE n_words >= {WINDOW}),
h AS (SELECT rid, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS s FROM g),
r AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM h),
p AS (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS j FROM r WHERE c > 1),
k AS (SELECT rid, CAST(sum(CASE WHEN j IS NULL THEN {WINDOW} ELSE least({WINDOW}, j - i) END) AS BIGINT) AS n_repeat_words FROM p GROUP BY rid),
m AS (SELECT doc_id, n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
 CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
 CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(ls) AS n_lines,
 len(list_filter(ws, lambda x: x IN ({_stop_set()}))) AS n_stop,
 len(list_filter(ws, lambda x: regexp_matches(x, '\\p{{L}}'))) AS n_alpha,
 len(list_filter(ls, lambda l: regexp_matches(ltrim(l), '^[-*•]'))) AS n_bullet,
 len(list_filter(ls, lambda l: rtrim(l) LIKE '%...' OR rtrim(l) LIKE '%…')) AS n_ellipsis
 FROM n LEFT JOIN k USING (rid)),
q AS (SELECT *, CASE WHEN n_words = 0 THEN 0.0 ELSE word_chars / n_words END AS mean_word_chars, CASE WHEN n_words = 0 THEN 0.0 ELSE n_symbols / n_words END AS symbol_ratio,
 CASE WHEN n_words = 0 THEN 0.0 ELSE n_stop / n_words END AS stop_ratio, CASE WHEN n_lines = 0 THEN 0.0 ELSE n_dup_lines / n_lines END AS dup_line_ratio,
 CASE WHEN n_lines = 0 THEN 0.0 ELSE n_bullet / n_lines END AS bullet_line_ratio, CASE WHEN n_lines = 0 THEN 0.0 ELSE n_ellipsis / n_lines END AS ellipsis_line_ratio,
 CASE WHEN n_words = 0 THEN 0.0 ELSE n_alpha / n_words END AS alpha_word_ratio,
 (n_words < {BASE_MIN_WORDS} OR 100 * n_repeat_words > {BASE_MAX_REPEAT_PERCENT} * n_words) AS base_failed FROM m),
f AS (SELECT *, concat_ws(',', {', '.join(rules)}) AS failed_rules FROM q)
SELECT doc_id, {', '.join(_COUNTS)}, base_failed, (NOT base_failed AND failed_rules = '') AS kept, {', '.join(f'round({c}, 6) AS {c}' for c in _RATIOS)}, failed_rules FROM f"""
