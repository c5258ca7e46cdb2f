"""Hand-made texts for extraction, normalisation and comparison."""

from pyspark.sql import functions as F

from spoor.functions import text as tx


def apply(spark, fn, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[1] for r in df.select("i", fn(F.col("t"))).orderBy("i").collect()]


def test_boxed(spark):
    got = apply(
        spark, tx.boxed, r"so \boxed{\frac{1}{2}} ok", r"\boxed{a} and \boxed{b}", r"\boxed{a} \boxed{b{c}", "none", r"\boxed {x}", r"\boxed{}", None
    )
    assert got == [r"\frac{1}{2}", "b", None, None, "x", "", None]


def test_keywords_and_lines(spark):
    assert apply(spark, tx.keyword_answer, "The answer is: 42.\n\nbye", "thus 3 therefore 5", "final answer: 7!\n\nfinal answer: 8", "nothing") == [
        "42", "5", "8", None,
    ]
    assert apply(spark, tx.last_line, "a\nAnswer: 5.\n \n", "  \n ", "x") == ["5", None, "x"]


def test_cascade(spark):
    got = [tuple(x) for x in apply(spark, tx.answer_with_metadata, r"\boxed{1}", "the answer is 2", "just 3", "", None)]
    assert got == [("1", "boxed", 1.0), ("2", "keyword", 0.8), ("just 3", "last_line", 0.5), (None, "failed", 0.0), (None, "failed", 0.0)]


def test_headers_and_brackets(spark):
    assert apply(spark, tx.header_answer, "### The final answer is: 9.\nmore", "### Final answer: \\boxed{}\n", r"\boxed{4}") == ["9", "\\boxed{}", "4"]
    assert apply(spark, tx.bracketed, "[[ a ]] [[b]]", "[c] [d]", "none") == ["b", "d", None]
    assert apply(spark, lambda c: tx.bracketed(c, last=False), "[[ a ]] [[b]]", "[c] [d]") == ["a", "c"]
    assert apply(spark, tx.tagged, "<answer> x\ny </answer><answer>z</answer>", "no") == ["x\ny", None]


def test_code(spark):
    two = "a\n```python\nx = 1\n```\nb\n```\ny = 2\nz\n```"
    assert apply(spark, tx.fenced_code, two, "```\nonly", "plain") == ["y = 2\nz", "", ""]
    long = "```python\nimport os\nprint(os.name, 1)\n```\n```python\nx\n```"
    assert apply(spark, tx.code_block, long, "```python\nx\n```", "text\nimport os\nx = 1\nbye", "none here", "") == [
        "import os\nprint(os.name, 1)", "x", "import os\nx = 1", None, None,
    ]
    assert apply(spark, tx.assert_line, "assert a\nassert b\nx", "```\nq\n```", "```\nz\n```python\nw\n```", "none") == ["assert b", "q", "w", ""]
    assert apply(spark, tx.execution_value, "f(1) == 3\nmore", "5[/ANSWER] x", "7\n8") == ["3", "5", "7"]
    assert apply(spark, lambda c: tx.execution_value(c, True), "t [ANSWER] f == 4 [/ANSWER]") == ["4"]


def test_normalise(spark):
    got = apply(
        spark, tx.normalise_answer, "1,000", r"\dfrac{1}{2}", "5 km", ".5", "3.0", r"\text{ab} + \mathrm{c}", "( a , b ).", r"\left( 2 \right)", "", None, "90 degrees"
    )
    assert got == ["1000", r"\frac{1}{2}", "5", "0.5", "3", "ab+c", "(a , b)", "(2)", "", "", "90"]
    assert apply(spark, tx.normalise_text, "The  Cat, a an ate!", "à la fin", None) == ["cat ate", "à la fin", None]


def test_numbers(spark):
    assert apply(spark, tx.parse_number, "3/4", r"\frac{1}{4}", "1e3", "3/0", "x", "1d", " 2 ") == [0.75, 0.25, 1000.0, None, None, None, 2.0]
    assert apply(spark, tx.parse_digits, "50%", r"50\%", "1,000", "5", "%") == [0.5, 0.5, 1000.0, 5.0, None]


def pair(spark, fn, *pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    return [r[1] for r in df.select("i", fn(F.col("a"), F.col("b"))).orderBy("i").collect()]


def test_compare(spark):
    got = pair(spark, tx.compare_answers, ("1/2", "0.5"), ("a", "a"), ("5", r"5\text{ km}"), ("1", "2"), ("1", None))
    assert [tuple(x) for x in got] == [
        (True, "numeric"), (True, "exact"), (True, "exact_cleaned"), (False, "failed"), (False, "failed"),
    ]


def test_math_equal(spark):
    cases = [
        ("Yes", "yes", True), ("(B)", "B", True), ("B. 5", "5", True), ("2, 1", "1,2", True), ("50%", "0.5", True), ("50", "0.5", True),
        ("(1, 2)", "(1,2)", True), ("(1, 2)", "(2,1)", False), ("[1,3]", "1,3", True), ("1", "2", False), (None, "1", False), ("1.00001", "1", True),
        ("{x}", "x", True), ("", "x", False),
    ]
    assert pair(spark, tx.math_equal, *[(p, r) for p, r, _ in cases]) == [w for *_, w in cases]


def test_structured(spark):
    a = apply(spark, tx.structured_key, "[' A', 2]", '["a",2]', "A  b", '" X "')
    assert a[0] == a[1] and a[2:] == ["ab", '"x"']
    assert apply(spark, tx.alphanumeric, "[[A-b 1]]") == ["ab1"]
    assert apply(spark, tx.cutoff_applied, "a  \n", "a") == [True, False]


def test_shared_grams_by_hash(spark):
    """Short, empty and null texts, repeats, and runs that differ in one word or in where a word ends."""
    from spoor.operators import corpus

    items = spark.createDataFrame([(1, "a b c d"), (2, "a b"), (3, None), (4, ""), (5, "x a b c ```a b d"), (6, "ab c d")], "item_id int, text string")
    docs = spark.createDataFrame([("a  b c", "s"), ("a b c", None), ("a bc d", "s"), (None, "s"), ("", "t")], "text string, shard string")
    got = sorted(map(tuple, corpus.shared_grams(items, docs, 3).collect()))
    assert got == [(1, "a b c"), (5, "a b c")]
    hits = corpus.shard_hits(items, docs, "shard", 3).collect()
    assert {tuple(r) for r in hits} == {("s", 1), ("s", 5), (None, 1), (None, 5)}
    assert corpus.overlap_percentage(items, docs.limit(0), 3).first()["overlap_percent"] == 0.0
