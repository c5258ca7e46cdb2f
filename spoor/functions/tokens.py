"""Predicates on single tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters and marks that must equal the original rules.
PUNCTUATION = ".,;:!?()[]{}\"'`-–—…/\\|@#$%^&*+=<>~"
SENTENCE_ENDS = [".", "!", "?", "。", "！", "？"]
TRAILING_SPECIALS = ["<|im_end|>", "<|return|>", "<|endoftext|>", "</s>"]
MATH_OPERATORS = [
    "+", "-", "*", "/", "=", "<", ">", "≤", "≥", "≠", "×", "÷", "±", "∓", "^", "²", "³", "√", "∛",
    "(", ")", "[", "]", "{", "}", ".", ",", "%", "°", "∑", "∏", "∫", "∂", "∞", "π", "e",
    "\\frac", "\\sqrt", "\\sum", "\\int", "\\pi",
]
MATH_NAMES = ["frac", "sqrt", "sum", "int", "pi"]

_SPACE = r"^\s+|\s+$"


def stripped(token: Column) -> Column:
    return F.regexp_replace(token, _SPACE, "")


def is_punctuation_or_digit(token: Column) -> Column:
    rest = F.translate(F.regexp_replace(token, r"[\s\d]", ""), PUNCTUATION, "")
    return F.length(rest) == 0


def ends_sentence(token: Column) -> Column:
    return token.rlike("[" + "".join(SENTENCE_ENDS) + "]")


def is_trailing_special(token: Column) -> Column:
    hit = F.lit(False)
    for s in TRAILING_SPECIALS:
        hit = hit | token.contains(s)
    return hit


def is_math_symbol(token: Column) -> Column:
    """E-12: numbers, operators and LaTeX maths."""
    t = stripped(token)
    latex = t.contains("\\") & t.rlike("|".join(MATH_NAMES))
    return t.rlike(r"\d") | t.isin(MATH_OPERATORS) | latex
