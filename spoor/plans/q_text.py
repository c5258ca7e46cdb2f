"""Queries for answer extraction, normalisation and grading (X, E-20, E-21). Texts are whole documents."""

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import grading
from ..operators.repetition import repeated
from . import fixtures as fx
from .registry import CTES, query

# Documents with an answer of some kind after the text, and a truth to compare with.
CTES["gen"] = r"""SELECT doc_id, CASE doc_id % 10
  WHEN 0 THEN concat(text, E'\n\nThe final answer is: ', CAST(n_chars AS STRING), E'.\n\nBye')
  WHEN 1 THEN concat(text, ' \boxed{\frac{', CAST(doc_id AS STRING), '}{4}} ok } {')
  WHEN 2 THEN concat(text, E'\n\n[[', lang, ']] and [[ ', source, ' ]]')
  WHEN 3 THEN concat(text, ' <answer> ', lang, ' </answer> tail <answer>x</answer>')
  WHEN 4 THEN concat(text, E'\n```python\nprint("', CAST(doc_id AS STRING), E'")  # a longer line\n```\nend')
  WHEN 5 THEN concat(text, E'\nassert f(1) == ', CAST(doc_id AS STRING), E'\ndone')
  WHEN 6 THEN concat(text, ' \boxed{a} then \boxed{b{c}')
  WHEN 7 THEN concat(text, E'\n\n### Final answer: ', '\boxed{', CAST(n_chars AS STRING), E'} \n')
  WHEN 8 THEN concat(text, E'\nThus, ', CAST(n_chars AS STRING), E'.0 ;\n\n') ELSE text END AS body,
  CASE doc_id % 10 WHEN 1 THEN CAST(doc_id / 4.0 AS STRING) WHEN 2 THEN source WHEN 3 THEN lang ELSE CAST(n_chars AS STRING) END AS truth, lang, source, n_chars FROM documents"""


def gen(spark, sf):
    d = fx.table(spark, sf, "documents")
    t, n, c = F.col("text"), F.col("doc_id").cast("string"), F.col("n_chars").cast("string")
    m = F.col("doc_id") % 10
    j = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    body = (
        F.when(m == 0, j(t, "\n\nThe final answer is: ", c, ".\n\nBye"))
        .when(m == 1, j(t, " \\boxed{\\frac{", n, "}{4}} ok } {"))
        .when(m == 2, j(t, "\n\n[[", F.col("lang"), "]] and [[ ", F.col("source"), " ]]"))
        .when(m == 3, j(t, " <answer> ", F.col("lang"), " </answer> tail <answer>x</answer>"))
        .when(m == 4, j(t, '\n```python\nprint("', n, '")  # a longer line\n```\nend'))
        .when(m == 5, j(t, "\nassert f(1) == ", n, "\ndone"))
        .when(m == 6, j(t, " \\boxed{a} then \\boxed{b{c}"))
        .when(m == 7, j(t, "\n\n### Final answer: \\boxed{", c, "} \n"))
        .when(m == 8, j(t, "\nThus, ", c, ".0 ;\n\n"))
        .otherwise(t)
    )
    truth = F.when(m == 1, (F.col("doc_id") / 4.0).cast("string")).when(m == 2, F.col("source")).when(m == 3, F.col("lang")).otherwise(c)
    return d.select("doc_id", body.alias("body"), truth.alias("truth"), "lang", "source", "n_chars")


def _mapped(fn, name="answer"):
    return lambda spark, sf: gen(spark, sf).select("doc_id", fn(F.col("body")).alias(name))


# Balanced braces in SQL: the depth after each character of the text behind the last marker.
CTES["box_tail"] = r"""SELECT doc_id, string_split_regex(body, '\\boxed\s*\{')[-1] AS tail FROM gen WHERE regexp_matches(body, '\\boxed\s*\{')"""
CTES["box_end"] = """SELECT doc_id, min(i) AS e FROM (SELECT doc_id, i, 1 + sum(CASE ch WHEN '{' THEN 1 WHEN '}' THEN -1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS depth
  FROM (SELECT doc_id, unnest(string_split(tail, '')) AS ch, generate_subscripts(string_split(tail, ''), 1) AS i FROM box_tail)) WHERE depth = 0 GROUP BY doc_id"""
CTES["boxes"] = "SELECT g.doc_id, CASE WHEN b.e IS NOT NULL THEN substr(t.tail, 1, CAST(b.e - 1 AS BIGINT)) END AS boxed FROM gen g LEFT JOIN box_tail t ON t.doc_id = g.doc_id LEFT JOIN box_end b ON b.doc_id = g.doc_id"


@query("X01_boxed", "SELECT doc_id, boxed AS answer FROM boxes")
def x01(spark, sf):
    return _mapped(tx.boxed)(spark, sf)


_WS = r"[\s\p{Z}]"


def _strip(e):
    return f"regexp_replace({e}, '^{_WS}+|{_WS}+$', '', 'g')"


def _rstrip(e, chars):
    return f"regexp_replace({e}, '[{chars}]+$', '')"


def _all(e, pattern, g=1):
    return f"regexp_extract_all({e}, '{pattern}', {g})"


CTES["keyword_rows"] = "SELECT doc_id, coalesce(" + ", ".join(
    f"nullif({_rstrip(_strip(_all('body', '(?is)' + kw + '(.+?)(?:' + chr(92) + 'n' + chr(92) + 'n|$)') + '[-1]'), '.!?,;')}, '')" for kw in tx.KEYWORDS
) + ") AS keyword FROM gen"
CTES["line_rows"] = f"""SELECT doc_id, {_rstrip("regexp_replace(list_filter(list_transform(string_split(" + _strip('body') + ", chr(10)), lambda x: " + _strip('x') + "), lambda x: x <> '')[-1], '^(answer|result|solution)[ ]*:?[ ]*', '', 'i')", '.!?,;')} AS line FROM gen"""


@query("X02_keyword_answer", "SELECT doc_id, keyword AS answer FROM keyword_rows")
def x02(spark, sf):
    return _mapped(tx.keyword_answer)(spark, sf)


@query("X03_last_line", "SELECT doc_id, line AS answer FROM line_rows")
def x03(spark, sf):
    return _mapped(tx.last_line)(spark, sf)


CTES["cascade"] = """SELECT b.doc_id, coalesce(b.boxed, k.keyword, l.line) AS answer, CASE WHEN b.boxed IS NOT NULL THEN 'boxed' WHEN k.keyword IS NOT NULL THEN 'keyword' WHEN l.line IS NOT NULL THEN 'last_line' ELSE 'failed' END AS method,
  CASE WHEN b.boxed IS NOT NULL THEN 1.0 WHEN k.keyword IS NOT NULL THEN 0.8 WHEN l.line IS NOT NULL THEN 0.5 ELSE 0.0 END AS confidence
  FROM boxes b JOIN keyword_rows k ON k.doc_id = b.doc_id JOIN line_rows l ON l.doc_id = b.doc_id"""


@query("X04_answer_cascade", "SELECT * FROM cascade", "confidence")
def x04(spark, sf):
    return gen(spark, sf).select("doc_id", tx.answer_with_metadata(F.col("body")).alias("a")).select("doc_id", "a.*")


_HEAD = [r"###\s*the\s+final\s+answer\s+is[:\s]*", r"###\s*final\s+answer[:\s]*", r"the\s+final\s+answer\s+is[:\s]*"]
_HIT = "coalesce(" + ", ".join(f"{_all('body', '(?is)' + h + '(.+?)(?:' + chr(92) + 'n|$)')}[1]" for h in _HEAD) + ")"


@query(
    "X05_header_answer",
    f"SELECT g.doc_id, coalesce(nullif(b.boxed, ''), CASE WHEN {_HIT} IS NOT NULL THEN nullif({_rstrip(_strip(_HIT), '.!?,;')}, '') ELSE k.keyword END) AS answer FROM gen g JOIN boxes b ON b.doc_id = g.doc_id JOIN keyword_rows k ON k.doc_id = g.doc_id",
)
def x05(spark, sf):
    return _mapped(tx.header_answer)(spark, sf)


_B2, _B1 = r"(?s)\[\[\s*(.*?)\s*\]\]", r"(?s)\[\s*(.*?)\s*\]"


@query("X06_bracketed", f"SELECT doc_id, {_strip(f'coalesce({_all('body', _B2)}[-1], {_all('body', _B1)}[-1])')} AS answer FROM gen")
def x06(spark, sf):
    return _mapped(tx.bracketed)(spark, sf)


@query("X06_bracketed_first", f"SELECT doc_id, {_strip(f'coalesce({_all('body', _B2)}[1], {_all('body', _B1)}[1])')} AS answer FROM gen")
def x06b(spark, sf):
    return _mapped(lambda c: tx.bracketed(c, last=False))(spark, sf)


@query("X07_tagged", f"SELECT doc_id, {_strip(_all('body', '(?s)<answer>(.*?)</answer>') + '[1]')} AS answer FROM gen")
def x07(spark, sf):
    return _mapped(tx.tagged)(spark, sf)


CTES["lined"] = "SELECT doc_id, body, string_split(body, chr(10)) AS lines FROM gen"
CTES["fenced"] = "SELECT *, list_filter(range(1, CAST(len(lines) + 1 AS BIGINT)), lambda i: contains(lines[i], '```')) AS marks FROM lined"


@query("X08_fenced_code", "SELECT doc_id, CASE WHEN len(marks) >= 2 THEN array_to_string(list_slice(lines, marks[-2] + 1, marks[-1] - 1), chr(10)) ELSE '' END AS code FROM fenced")
def x08(spark, sf):
    return _mapped(tx.fenced_code, "code")(spark, sf)


@query(
    "X09_code_block",
    f"SELECT doc_id, count(*) AS n, max(code) AS code FROM (SELECT doc_id, {_strip(_all('body', '(?s)```[Pp]ython' + chr(92) + 's*' + chr(92) + 'n(.*?)```') + '[-1]')} AS code FROM gen) WHERE code IS NOT NULL GROUP BY doc_id",
)
def x09(spark, sf):
    g = gen(spark, sf).filter(F.col("body").contains("```python"))
    return g.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(tx.code_block(F.col("body"))).alias("code"))


@query(
    "X10_assert_line",
    "SELECT doc_id, coalesce(list_filter(lines, lambda l: starts_with(l, 'assert'))[-1], CASE WHEN len(marks) >= 2 THEN array_to_string(list_slice(lines, marks[1] + 1, marks[2] - 1), chr(10)) ELSE '' END) AS code FROM fenced",
)
def x10(spark, sf):
    return _mapped(tx.assert_line, "code")(spark, sf)


@query(
    "X11_execution_value",
    f"SELECT doc_id, {_strip('string_split(t, chr(10))[1]')} AS value FROM (SELECT doc_id, CASE WHEN contains(body, '==') THEN {_strip('string_split(body, chr(61) || chr(61))[2]')} ELSE body END AS t FROM gen)",
)
def x11(spark, sf):
    return _mapped(tx.execution_value, "value")(spark, sf)


@query("X12_normalised_answers")
def x12(spark, sf):
    """Regular expressions here look ahead and behind, which the oracle's engine lacks; tested on fixtures."""
    return _mapped(lambda c: tx.normalise_answer(tx.last_line(c)), "normalised")(spark, sf)


CTES["words_only"] = r"""SELECT doc_id, array_to_string(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}\p{Pc}]+|[^\p{L}\p{M}\p{N}\p{Pc}]+'), lambda w: w NOT IN ('the', 'a', 'an')), '') AS t FROM documents"""


@query("X13_normalised_text", r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(t, '[^\p{L}\p{N}_\s]', '', 'g'), '[\s\p{Z}]+', ' ', 'g'), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS h FROM words_only")
def x13(spark, sf):
    d = fx.table(spark, sf, "documents")
    return d.select("doc_id", F.md5(tx.normalise_text(F.col("text"))).alias("h"))


CTES["number_texts"] = r"""SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN CAST(p_size AS STRING) WHEN 1 THEN concat(CAST(p_size AS STRING), ' / ', CAST(p_size % 4 AS STRING)) WHEN 2 THEN concat('\frac{', CAST(p_size AS STRING), '}{4}')
  WHEN 3 THEN concat(CAST(p_size AS STRING), '%') WHEN 4 THEN concat('1,', CAST(100 + p_size AS STRING)) WHEN 5 THEN p_brand WHEN 6 THEN concat('.', CAST(p_size AS STRING)) ELSE concat(CAST(p_size AS STRING), '\%') END AS t, p_size FROM part"""


def numbers(spark, sf):
    p = fx.table(spark, sf, "part")
    m, z = F.col("p_partkey") % 8, F.col("p_size").cast("string")
    t = (
        F.when(m == 0, z)
        .when(m == 1, F.concat(z, F.lit(" / "), (F.col("p_size") % 4).cast("string")))
        .when(m == 2, F.concat(F.lit("\\frac{"), z, F.lit("}{4}")))
        .when(m == 3, F.concat(z, F.lit("%")))
        .when(m == 4, F.concat(F.lit("1,"), (100 + F.col("p_size")).cast("string")))
        .when(m == 5, F.col("p_brand"))
        .when(m == 6, F.concat(F.lit("."), z))
        .otherwise(F.concat(z, F.lit("\\%")))
    )
    return p.select("p_partkey", t.alias("t"), "p_size")


CTES["number_values"] = r"""SELECT p_partkey, t, p_size, CASE p_partkey % 8 WHEN 0 THEN p_size WHEN 1 THEN CASE WHEN p_size % 4 <> 0 THEN p_size / CAST(p_size % 4 AS DOUBLE) END WHEN 2 THEN p_size / 4.0 WHEN 6 THEN TRY_CAST(t AS DOUBLE) END AS number,
  CASE p_partkey % 8 WHEN 0 THEN p_size WHEN 3 THEN p_size / 100.0 WHEN 4 THEN 1100 + p_size WHEN 6 THEN TRY_CAST(t AS DOUBLE) WHEN 7 THEN p_size / 100.0 END AS digits FROM number_texts"""


@query("X14_numbers", "SELECT p_partkey, CAST(number AS DOUBLE) AS number, CAST(digits AS DOUBLE) AS digits FROM number_values", "number digits")
def x14(spark, sf):
    t = F.col("t")
    return numbers(spark, sf).select("p_partkey", tx.parse_number(t).alias("number"), tx.parse_digits(t).alias("digits"))


@query(
    "X15_compare_answers",
    "SELECT p_partkey, coalesce(t = CAST(p_size AS STRING) OR p_partkey % 8 = 6 OR abs(number - p_size) <= 1e-9 + 1e-6 * abs(number), false) AS is_correct, CASE WHEN t = CAST(p_size AS STRING) OR p_partkey % 8 = 6 THEN 'exact' WHEN abs(number - p_size) <= 1e-9 + 1e-6 * abs(number) THEN 'numeric' ELSE 'failed' END AS comparison_method FROM number_values",
)
def x15(spark, sf):
    c = tx.compare_answers(F.col("p_size").cast("string"), F.col("t"))
    return numbers(spark, sf).select("p_partkey", c.alias("c")).select("p_partkey", "c.*").withColumn(
        "comparison_method", F.regexp_replace("comparison_method", "_cleaned$", "")
    )


@query(
    "X16_math_equal",
    "SELECT p_partkey, coalesce(digits IS NOT NULL AND (abs(digits - p_size / 100.0) <= 1e-4 OR abs(digits - p_size) <= 1e-4 OR abs(digits - p_size * 100) <= 1e-4), false) AS equal FROM number_values",
)
def x16(spark, sf):
    e = tx.math_equal(F.col("t"), F.col("p_size").cast("string"))
    return numbers(spark, sf).select("p_partkey", e.alias("equal"))


@query(
    "X17_structured_keys",
    "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN concat('[\"', lower(c_mktsegment), '\",', CAST(c_nationkey AS STRING), ']') WHEN 1 THEN lower(c_mktsegment) ELSE concat('\"', lower(c_mktsegment), '\"') END AS key FROM customer",
)
def x17(spark, sf):
    c = fx.table(spark, sf, "customer")
    m, g = F.col("c_custkey") % 3, F.col("c_mktsegment")
    t = (
        F.when(m == 0, F.concat(F.lit("[' "), g, F.lit("' , "), F.col("c_nationkey").cast("string"), F.lit(" ]")))
        .when(m == 1, F.concat(F.lit(" "), F.substr(g, F.lit(1), F.lit(3)), F.lit("  "), F.substr(g, F.lit(4))))
        .otherwise(F.concat(F.lit("'"), g, F.lit(" '")))
    )
    return c.select("c_custkey", tx.structured_key(t).alias("key"))


@query("X18_alphanumeric", "SELECT doc_id, md5(lower(regexp_replace(text, '[^A-Za-z0-9]', '', 'g'))) AS h FROM documents")
def x18(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", F.md5(tx.alphanumeric(F.col("text"))).alias("h"))


@query(
    "X19_similarity",
    "SELECT p_partkey, 1 - levenshtein(p_name, p_type) / CAST(greatest(length(p_name), length(p_type)) AS DOUBLE) AS similarity FROM part",
    "similarity",
)
def x19(spark, sf):
    s = tx.similarity(F.col("p_name"), F.col("p_type"))
    return fx.table(spark, sf, "part").select("p_partkey", s.alias("similarity"))


@query(
    "X20_grading",
    """SELECT g.doc_id, c.answer AS extracted_answer, c.method, coalesce(c.answer = g.truth OR (TRY_CAST(c.answer AS DOUBLE) = TRY_CAST(g.truth AS DOUBLE)) OR (g.doc_id % 10 = 1 AND c.method = 'boxed'), false) AS is_correct
    FROM gen g JOIN cascade c ON c.doc_id = g.doc_id""",
)
def x20(spark, sf):
    """The whole job: extraction cascade, then comparison with the truth."""
    g = gen(spark, sf).withColumn("a", tx.answer_with_metadata(F.col("body")))
    g = grading.compared(g.select("doc_id", F.col("a.answer").alias("extracted_answer"), "a.method", "truth"), "truth", "extracted_answer", "verdict")
    return g.select("doc_id", "extracted_answer", "method", F.coalesce(F.col("verdict") != "failed", F.lit(False)).alias("is_correct"))


# Samples of several task types in one table; some truths are whole solutions, some lie in a later column.
CTES["samples"] = r"""SELECT doc_id, concat('q', CAST(doc_id AS STRING), '_traj_0') AS traj_id, CASE doc_id % 10 WHEN 2 THEN 'choice' WHEN 3 THEN 'logic' WHEN 9 THEN NULL ELSE 'math' END AS task_type,
  CASE WHEN doc_id % 4 > 0 THEN lang END AS subtype, body AS generated_text, CASE doc_id % 10 WHEN 7 THEN concat('so it is \boxed{', truth, '}') WHEN 8 THEN '' WHEN 9 THEN NULL ELSE truth END AS solution,
  CASE WHEN doc_id % 10 = 8 THEN truth END AS answer, truth FROM gen"""


def samples(spark, sf):
    g, m = gen(spark, sf), F.col("doc_id") % 10
    return g.select(
        F.concat(F.lit("q"), F.col("doc_id").cast("string"), F.lit("_traj_0")).alias("traj_id"),
        F.lit(None).cast("string").alias("original_id"),
        F.when(m == 2, "choice").when(m == 3, "logic").when(m != 9, "math").alias("task_type"),
        F.when(F.col("doc_id") % 4 > 0, F.col("lang")).alias("subtype"),
        F.col("body").alias("generated_text"),
        F.when(m == 7, F.concat(F.lit("so it is \\boxed{"), "truth", F.lit("}"))).when(m == 8, "").when(m != 9, F.col("truth")).alias("solution"),
        F.when(m == 8, F.col("truth")).alias("answer"),
        F.lit(None).cast("string").alias("final_answer"),
    )


def _float(e):
    return f"CASE WHEN regexp_matches({e}, '^\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*$') THEN TRY_CAST(trim({e}) AS DOUBLE) END"


def _number(e):
    """A number, a fraction written with a slash, or a LaTeX fraction."""
    s = _strip(f"replace({e}, chr(92), '')")
    frac, slash = "^frac\\{([^}]+)\\}\\{([^}]+)\\}$", "^(\\d+(?:\\.\\d+)?)\\s*/\\s*(\\d+(?:\\.\\d+)?)$"
    out = _float(f"replace({e}, chr(92), '')")
    for p in (frac, slash):
        n, d = (_float(f"regexp_extract({s}, '{p}', {k})") for k in (1, 2))
        out = f"CASE WHEN regexp_matches({s}, '{p}') AND ({n}) IS NOT NULL AND ({d}) IS NOT NULL THEN CASE WHEN ({d}) <> 0 THEN ({n}) / ({d}) END ELSE {out} END"
    return out


def _cleaned(e):
    for pattern, to in tx.CLEAN:
        e = f"regexp_replace({e}, '{pattern}', '{to}', 'g')"
    return f"regexp_replace({e}, '^[ ,;.]+|[ ,;.]+$', '', 'g')"


CTES["sample_answers"] = f"""SELECT s.*, CASE task_type WHEN 'choice' THEN {_strip(f"coalesce({_all('generated_text', _B2)}[-1], {_all('generated_text', _B1)}[-1])")}
  WHEN 'logic' THEN coalesce({_strip(_all('generated_text', '\\[\\[([^\\]]+)\\]\\]') + '[1]')}, {_strip(_all('generated_text', '(?is)<answer>(.*?)</answer>') + '[1]')}) ELSE c.answer END AS extracted,
  CASE WHEN doc_id % 10 <> 9 THEN truth END AS ground_truth FROM samples s JOIN cascade c USING (doc_id)"""
CTES["sample_numbers"] = f"""SELECT *, {_number("ground_truth")} AS x, {_number("extracted")} AS y, {_number("cleaned")} AS z FROM (SELECT *, {_cleaned("extracted")} AS cleaned FROM sample_answers)"""
CTES["sample_methods"] = """SELECT *, CASE WHEN extracted IS NULL OR ground_truth IS NULL THEN 'none' WHEN task_type IN ('choice', 'logic') THEN concat(task_type, '_', coalesce(nullif(subtype, ''), 'unknown'))
  WHEN ground_truth = extracted THEN 'exact' WHEN abs(x - y) <= 1e-9 + 1e-6 * abs(y) THEN 'numeric'
  WHEN cleaned <> extracted AND cleaned <> '' AND ground_truth = cleaned THEN 'exact_cleaned' WHEN cleaned <> extracted AND cleaned <> '' AND abs(x - z) <= 1e-9 + 1e-6 * abs(z) THEN 'numeric_cleaned' ELSE 'failed' END AS method FROM sample_numbers"""


@query(
    "X20_mixed_grading",
    """SELECT traj_id, concat('q', CAST(doc_id AS STRING)) AS original_id, task_type, extracted AS extracted_answer, ground_truth, method AS comparison_method,
    CASE WHEN method = 'none' THEN false WHEN task_type IN ('choice', 'logic') THEN lower(replace(extracted, ' ', '')) = lower(replace(ground_truth, ' ', '')) ELSE method <> 'failed' END AS is_correct FROM sample_methods""",
)
def x20b(spark, sf):
    """Rules by task type, truths from several columns or out of a box, one record per trajectory."""
    return grading.graded(samples(spark, sf))


@query("X21_answers_only", "SELECT doc_id, answer FROM cascade WHERE answer IS NOT NULL")
def x21(spark, sf):
    g = gen(spark, sf).select("doc_id", tx.answer_with_metadata(F.col("body"))["answer"].alias("answer"))
    return g.filter("answer IS NOT NULL")


@query("E20_repetition")
def e20(spark, sf):
    d = fx.table(spark, sf, "documents").select("doc_id", "text")
    body = F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.repeat(F.concat(F.lit("and so the same line comes once more, number "), F.col("doc_id").cast("string"), F.lit("; ")), F.lit(4)))).otherwise(F.col("text"))
    return repeated(d.withColumn("text", body), "text").select("doc_id", "repeats_from")


@query("E21_cutoff", f"SELECT doc_id, length(regexp_replace(body, '{_WS}+$', '')) < length(body) AS cutoff FROM gen")
def e21(spark, sf):
    return _mapped(tx.cutoff_applied, "cutoff")(spark, sf)
