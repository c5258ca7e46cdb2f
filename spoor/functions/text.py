"""Answer extraction, normalisation and comparison as column expressions (X-01 .. X-19, E-21)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\p{Z}]"

# Patterns, in order, that must equal the original rules.
KEYWORDS = [
    r"final answer\s*:?\s*",
    r"the answer is\s*:?\s*",
    r"therefore\s*,?\s*",
    r"thus\s*,?\s*",
    r"so\s+the\s+answer\s+is\s*:?\s*",
    r"answer\s*:?\s*",
]
HEADERS = [
    r"###\s*the\s+final\s+answer\s+is[:\s]*(.+?)(?:\n|$)",
    r"###\s*final\s+answer[:\s]*(.+?)(?:\n|$)",
    r"the\s+final\s+answer\s+is[:\s]*(.+?)(?:\n|$)",
]
LATEX = [
    (r"\\dfrac", r"\\frac"),
    (r"\\tfrac", r"\\frac"),
    (r"\\left\(", "("),
    (r"\\right\)", ")"),
    (r"\\left\[", "["),
    (r"\\right\]", "]"),
    (r"\\left\\\{", "{"),
    (r"\\right\\\}", "}"),
    (r"\\left\|", "|"),
    (r"\\right\|", "|"),
    (r"\\displaystyle\s*", ""),
    (r"\\scriptstyle\s*", ""),
    (r"\\textstyle\s*", ""),
    (r"\\text\{([^}]*)\}", "$1"),
    (r"\\mathrm\{([^}]*)\}", "$1"),
    (r"\\mathbf\{([^}]*)\}", "$1"),
    (r"\\mathit\{([^}]*)\}", "$1"),
    (r"\\cdot", "*"),
    (r"\\times", "*"),
    (r"\\infty", "oo"),
]
UNITS = [
    "kg", "g", "mg", "lb", "m", "km", "cm", "mm", "ft", "in", "s", "min", "hr", "h", "m/s", "km/h", "mph",
    r"m\^2", r"km\^2", r"cm\^2", r"m\^3", "L", "mL", "°C", "°F", "K", "degrees?",
]
NUMBERS = [(r"(?<![0-9])(\.)\s*([0-9]+)", "0.$2"), (r"(\d+)\.0+(?![0-9])", "$1"), (r"(\d+),(\d{3})", "$1$2")]
SPACES = [
    (r"\s*([+\-*/=<>])\s*", "$1"),
    (r"\(\s+", "("),
    (r"\s+\)", ")"),
    (r"\[\s+", "["),
    (r"\s+\]", "]"),
    (r"\{\s+", "{"),
    (r"\s+\}", "}"),
    (r"\s+", " "),
]
CLEAN = [
    (r"\\text\{[^}]*\}(\s*\^\{[^}]*\})?", ""),
    (r"\\[,;:!]", ""),
    (r"\\ ", " "),
    (r"\\(approx|sim|simeq|displaystyle|mathrm|mathbf|mathit|left|right|bigl|bigr|Bigl|Bigr|quad|qquad)", ""),
    (r"\s+", " "),
]
CHOICES = r"^(\([A-E]\)|[A-E]\.|[A-E]\)|\*\*[A-E]\*\*|[A-E]:)"


def _sub(c: Column, rules) -> Column:
    return reduce(lambda x, r: F.regexp_replace(x, r[0], r[1]), rules, c)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{WS}+|{WS}+$", "")


def _rstrip(c: Column, chars: str) -> Column:
    return F.regexp_replace(c, f"[{chars}]+$", "")


def _last(c: Column, pattern: str, group: int = 1) -> Column:
    return F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), F.lit(-1))


def _first(c: Column, pattern: str, group: int = 1) -> Column:
    return F.get(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), F.lit(0))


def boxed(text: Column) -> Column:
    """X-01: content of the last \\boxed{...} with balanced braces, else null.

    Folds over the pieces that end in a brace, not over characters.
    """
    parts = F.split(text, r"\\boxed\s*\{")
    tail = F.element_at(parts, -1)
    pieces = F.regexp_extract_all(tail, F.lit(r"[^{}]*[{}]"), F.lit(0))
    state = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("n"), F.lit(-1).alias("end"))

    def step(s: Column, p: Column) -> Column:
        depth = s["depth"] + F.when(p.endswith("{"), 1).otherwise(-1)
        n = s["n"] + F.length(p)
        done = s["end"] >= 0
        return F.struct(
            F.when(done, s["depth"]).otherwise(depth).alias("depth"),
            F.when(done, s["n"]).otherwise(n).alias("n"),
            F.when(done, s["end"]).when(depth == 0, n).otherwise(-1).alias("end"),
        )

    end = F.aggregate(pieces, state, step, lambda s: s["end"])
    return F.when((F.size(parts) > 1) & (end > 0), F.substr(tail, F.lit(1), end - 1))


def keyword_answer(text: Column) -> Column:
    """X-02: first keyword in priority order with a non-empty last match."""
    options = []
    for k in KEYWORDS:
        found = _rstrip(strip(_last(text, rf"(?is){k}(.+?)(?:\n\n|$)")), ".!?,;")
        options.append(F.nullif(found, F.lit("")))
    return F.coalesce(*options)


def last_line(text: Column) -> Column:
    """X-03: last non-empty line, answer prefix and closing punctuation removed."""
    lines = F.filter(F.transform(F.split(strip(text), "\n"), strip), lambda x: x != "")
    line = F.try_element_at(lines, F.lit(-1))
    return _rstrip(F.regexp_replace(line, r"(?i)^(answer|result|solution)\s*:?\s*", ""), ".!?,;")


def answer_with_metadata(text: Column) -> Column:
    """X-04: struct(answer, method, confidence) of the cascade boxed, keyword, last line."""
    b, k, l = boxed(text), keyword_answer(text), last_line(text)

    def pick(answer: Column, method: str, conf: float) -> Column:
        return F.struct(answer.alias("answer"), F.lit(method).alias("method"), F.lit(conf).alias("confidence"))

    none = pick(F.lit(None).cast("string"), "failed", 0.0)
    return (
        F.when(text.isNull() | (text == ""), none)
        .when(b.isNotNull(), pick(b, "boxed", 1.0))
        .when(k.isNotNull(), pick(k, "keyword", 0.8))
        .when(l.isNotNull(), pick(l, "last_line", 0.5))
        .otherwise(none)
    )


def header_answer(text: Column) -> Column:
    """X-05: boxed, else the first header pattern that matches, else keywords."""
    headers = []
    for p in HEADERS:
        hit = _first(text, rf"(?is){p}")
        clean = _rstrip(strip(hit), ".!?,;")
        headers.append((hit, F.coalesce(F.nullif(boxed(clean), F.lit("")), F.nullif(clean, F.lit("")))))
    out = keyword_answer(text)
    for hit, value in reversed(headers):
        out = F.when(hit.isNotNull(), value).otherwise(out)
    return F.coalesce(F.nullif(boxed(text), F.lit("")), out)


def bracketed(text: Column, last: bool = True) -> Column:
    """X-06: [[x]], else [x]; the last match, or the first for the other evaluator."""
    pick = _last if last else _first
    return strip(F.coalesce(pick(text, r"(?s)\[\[\s*(.*?)\s*\]\]"), pick(text, r"(?s)\[\s*(.*?)\s*\]")))


def tagged(text: Column) -> Column:
    """X-07: first <answer>...</answer>."""
    return strip(_first(text, r"(?s)<answer>(.*?)</answer>"))


def logic_answer(text: Column) -> Column:
    """First [[x]], else the answer tag in any case, else a non-empty box."""
    return F.coalesce(
        strip(_first(text, r"\[\[([^\]]+)\]\]")),
        strip(_first(text, r"(?is)<answer>(.*?)</answer>")),
        F.nullif(boxed(text), F.lit("")),
    )


def _line_indexes(lines: Column, hit) -> Column:
    marked = F.transform(lines, lambda l, i: F.when(hit(l), i))
    return F.filter(marked, lambda i: i.isNotNull())


def fenced_code(text: Column) -> Column:
    """X-08: the lines between the last two code fences; fewer than two give an empty text."""
    lines = F.split(text, "\n")
    at = _line_indexes(lines, lambda l: l.contains("```"))
    a, b = F.try_element_at(at, F.lit(-2)), F.try_element_at(at, F.lit(-1))
    body = F.array_join(F.slice(lines, a + 2, b - a - 1), "\n")
    return F.when(F.size(at) >= 2, body).otherwise("")


def code_block(text: Column) -> Column:
    """X-09: last python block over 20 characters, else the last python block, else any long block,
    else the span of code-looking lines."""
    python = F.transform(F.regexp_extract_all(text, F.lit(r"(?s)```[Pp]ython\s*\n(.*?)```"), F.lit(1)), strip)
    anyb = F.transform(F.regexp_extract_all(text, F.lit(r"(?s)```\s*\n(.*?)```"), F.lit(1)), strip)
    long = lambda blocks: F.try_element_at(F.filter(blocks, lambda b: F.length(b) > 20), F.lit(-1))
    lines = F.split(text, "\n")
    opens = _line_indexes(lines, lambda l: strip(l).rlike(r"^(import |from |def |class )"))
    first = F.get(opens, F.lit(0))
    looks = lambda l: strip(l).rlike(r"^(import |from |def |class )") | (
        (strip(l) != "") & ~strip(l).startswith("#") & (l.rlike(r"^[ \t]") | strip(l).rlike(r"[=(]"))
    )
    last = F.array_max(F.filter(_line_indexes(lines, looks), lambda i: i >= first))
    span = F.when(first.isNotNull(), F.array_join(F.slice(lines, first + 1, last - first + 1), "\n"))
    return F.when(text != "", F.coalesce(long(python), F.try_element_at(python, F.lit(-1)), long(anyb), span))


def assert_line(text: Column) -> Column:
    """X-10: last line starting with assert, else the first fenced block, python fences first."""
    lines = F.split(text, "\n")
    asserts = F.filter(lines, lambda l: l.startswith("assert"))
    fences = _line_indexes(lines, lambda l: l.contains("```"))
    start = F.get(_line_indexes(lines, lambda l: l.rlike("```[pP]ython")), F.lit(0))
    a = F.coalesce(start, F.get(fences, F.lit(0)))
    b = F.get(F.filter(fences, lambda i: i > a), F.lit(0))
    block = F.when(b.isNotNull(), F.array_join(F.slice(lines, a + 2, b - a - 1), "\n")).otherwise("")
    return F.coalesce(F.try_element_at(asserts, F.lit(-1)), block)


def execution_value(text: Column, cot: bool = False) -> Column:
    """X-11: after [ANSWER] (when reasoning is on), after ==, up to [/ANSWER] or the line end."""
    second = lambda c, mark, pat: F.when(c.contains(mark), strip(F.get(F.split(c, pat), F.lit(1)))).otherwise(c)
    t = second(text, "[ANSWER]", r"\[ANSWER\]") if cot else text
    t = second(t, "==", "==")
    upto = lambda pat: strip(F.get(F.split(t, pat), F.lit(0)))
    return F.when(t.contains("[/ANSWER]"), upto(r"\[/ANSWER\]")).otherwise(upto("\n"))


def normalise_answer(answer: Column) -> Column:
    """X-12: LaTeX, units, number format, blanks and closing punctuation."""
    a = _sub(strip(answer), LATEX)
    a = _sub(a, [(rf"(?i)\s*{u}(?=\s|$)", "") for u in UNITS])
    a = _sub(_sub(a, NUMBERS), SPACES)
    return F.coalesce(strip(_rstrip(a, ".!?,;:")), F.lit(""))


def normalise_text(answer: Column) -> Column:
    """X-13: lower case without articles and punctuation."""
    a = F.regexp_replace(F.lower(answer), r"(?U)\b(the|a|an)\b", "")
    return strip(F.regexp_replace(F.regexp_replace(a, r"[^\p{L}\p{N}_\s]", ""), rf"{WS}+", " "))


_FLOAT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def to_float(c: Column) -> Column:
    return F.when(c.rlike(_FLOAT), F.trim(c).try_cast("double"))


def parse_number(text: Column) -> Column:
    """X-14: a/b, \\frac{a}{b} or a plain number; null otherwise."""
    t = F.translate(text, "\\", "")
    s = strip(t)
    out = to_float(t)
    for p in (r"^frac\{([^}]+)\}\{([^}]+)\}$", r"^(\d+(?:\.\d+)?)\s*/\s*(\d+(?:\.\d+)?)$"):
        n, d = to_float(F.regexp_extract(s, p, 1)), to_float(F.regexp_extract(s, p, 2))
        out = F.when(s.rlike(p) & n.isNotNull() & d.isNotNull(), F.when(d != 0, n / d)).otherwise(out)
    return out


def parse_digits(text: Column) -> Column:
    """X-14: thousands separators and percent signs understood."""
    t = F.regexp_replace(text, ",", "")
    pct = to_float(F.regexp_replace(t, r"\\?%$", "")) / 100
    return F.coalesce(to_float(t), F.when(t.endswith("%"), pct))


def clean_latex(c: Column) -> Column:
    return F.regexp_replace(_sub(c, CLEAN), r"^[ ,;.]+|[ ,;.]+$", "")


def compare_answers(truth: Column, answer: Column, rtol: float = 1e-6, atol: float = 1e-9) -> Column:
    """X-15: struct(is_correct, comparison_method): exact, numeric, then both on the cleaned answer."""

    def method(a: Column) -> Column:
        x, y = parse_number(truth), parse_number(a)
        return F.when(truth == a, "exact").when(F.abs(x - y) <= atol + rtol * F.abs(y), "numeric")

    cleaned = clean_latex(answer)
    second = F.when((cleaned != answer) & (cleaned != ""), F.concat(method(cleaned), F.lit("_cleaned")))
    m = F.coalesce(method(answer), second)
    return F.struct(m.isNotNull().alias("is_correct"), F.coalesce(m, F.lit("failed")).alias("comparison_method"))


def choice_letter(c: Column) -> Column:
    """The option letter an answer names, else the trimmed answer."""
    p = F.regexp_replace(c, r"^\n+|\n+$", "")
    p = F.regexp_replace(F.trim(F.regexp_replace(_rstrip(p, "."), "/+$", "")), "^:+", "")
    up = F.upper(p)
    whole = F.nullif(F.regexp_extract(up, r"^\s*[\(\[\{]?\s*([A-E])\s*[\)\]\}]?\s*$", 1), F.lit(""))
    return F.coalesce(whole, _last(up, r"\b([A-E])\b"), _last(up, r"([A-E])"), F.regexp_replace(strip(p), r"^\.+|[./]+$", ""))


def _base_equal(p: Column, r: Column) -> Column:
    x, y = parse_digits(p), parse_digits(r)
    close = lambda v: F.abs(x - v) <= F.greatest(F.lit(1e-4), 1e-9 * F.greatest(F.abs(x), F.abs(v)))
    number = close(y / 100) | close(y) | close(y * 100)
    return (F.lower(p) == F.lower(r)) | F.coalesce(number, F.lit(False))


def math_equal(prediction: Column, reference: Column) -> Column:
    """X-16: equality without symbolic algebra: text, choice letters, numbers with /100 and x100,
    unordered comma lists, brackets ignored, ordered tuples."""
    p, r = strip(prediction), strip(reference)
    base = _base_equal(p, r)
    choice = r.rlike("^[A-E]$") & (choice_letter(p) == r)
    led = p.rlike(CHOICES) & _base_equal(strip(F.regexp_replace(p, CHOICES, "")), r)
    parts = lambda c: F.transform(F.split(c, ","), strip)

    def pairwise(a: Column, b: Column) -> Column:
        return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, _base_equal), lambda x: x)

    unordered = p.contains(",") & r.contains(",") & pairwise(F.array_sort(parts(p)), F.array_sort(parts(r)))
    numeric = parse_digits(p).isNotNull() & parse_digits(r).isNotNull()
    opened = (p.rlike(r"^\[.*\]$") & ~r.startswith("(")) | (p.rlike(r"^\(.*\)$") & ~r.startswith("["))
    edge = lambda c: F.when(opened, F.regexp_replace(c, r"^[\[\]()]+|[\[\]()]+$", "")).otherwise(c)
    bare = lambda c: F.lower(F.translate(edge(c), "{}()", ""))
    inner = lambda c: parts(F.substr(c, F.lit(2), F.length(c) - 2))
    tuples = p.rlike(r"^[(\[].+[)\]]") & r.rlike(r"^[(\[].+[)\]]") & pairwise(inner(p), inner(r))
    late = ~numeric & (p != "") & ((bare(p) == bare(r)) | tuples)
    out = base | choice | led | unordered | late
    return F.coalesce(out, F.lit(False))


def structured_key(answer: Column) -> Column:
    """X-17: JSON lists and scalars with strings trimmed and lower-cased; other text without blanks, lower case."""
    t = F.translate(strip(answer), "'", '"')
    is_json = F.try_parse_json(t).isNotNull()
    tight = F.regexp_replace(F.regexp_replace(F.lower(t), rf'"{WS}+|{WS}+"', '"'), rf"{WS}*([,:\[\]{{}}]){WS}*", "$1")
    return F.when(is_json, tight).otherwise(F.lower(F.regexp_replace(strip(answer), rf"{WS}+", "")))


def alphanumeric(c: Column) -> Column:
    """X-18."""
    return F.lower(F.regexp_replace(c, r"[^A-Za-z0-9]", ""))


def similarity(a: Column, b: Column) -> Column:
    """X-19: one minus the edit distance over the longer length. The original used a matching-block
    ratio in a step that its cascade leaves off; the two measures differ."""
    n = F.greatest(F.length(a), F.length(b))
    return F.when(n == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / n)


def without_trailing_blanks(text: Column) -> Column:
    return F.regexp_replace(text, rf"{WS}+$", "")


def cutoff_applied(text: Column) -> Column:
    """E-21: whether the post-processed text is shorter than the raw one."""
    return F.length(without_trailing_blanks(text)) < F.length(text)
