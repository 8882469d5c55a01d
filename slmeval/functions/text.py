"""Text expressions: prompt building and answer cleaning, all native Column expressions.

No Python UDF is involved, so these stay inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .._util import col

# Fixed values that must equal the reference's behaviour.
# The characters Python's str.strip() removes (str.isspace() is true for exactly these 29
# code points): U+0009..U+000D, U+001C..U+0020, U+0085, U+00A0, U+1680, U+2000..U+200A,
# U+2028, U+2029, U+202F, U+205F, U+3000.
PY_WHITESPACE_CODEPOINTS = (
    list(range(0x09, 0x0E))
    + list(range(0x1C, 0x21))
    + [0x85, 0xA0, 0x1680]
    + list(range(0x2000, 0x200B))
    + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
PY_WHITESPACE = "".join(chr(c) for c in PY_WHITESPACE_CODEPOINTS)

# The prompt template and the answer marker of the reference.
PROMPT_SCENARIO = "Scenario: "
PROMPT_QUESTION = "\nQuestion: "
PROMPT_ANSWER = "\nAnswer:"
ANSWER_PREFIX = "answer:"


def to_text(c, null_text: str | None = "None") -> Column:
    """Any column as text; NULL becomes ``null_text`` (pandas ``astype(str)`` gives 'None')."""
    c = col(c).cast("string")
    return c if null_text is None else F.coalesce(c, F.lit(null_text))


def build_prompt(scenario, question, null_text: str | None = "None") -> Column:
    """``Scenario: {scenario}\\nQuestion: {question}\\nAnswer:``."""
    return F.concat(
        F.lit(PROMPT_SCENARIO),
        to_text(scenario, null_text),
        F.lit(PROMPT_QUESTION),
        to_text(question, null_text),
        F.lit(PROMPT_ANSWER),
    )


def build_training_text(prompt, answer, null_text: str | None = "None") -> Column:
    """Training text: prompt, one space, answer."""
    return F.concat(col(prompt), F.lit(" "), to_text(answer, null_text))


def py_strip(c) -> Column:
    """Python ``str.strip()``: removes the 29 Unicode whitespace code points at both ends."""
    return F.btrim(col(c), F.lit(PY_WHITESPACE))


def first_line(c) -> Column:
    """Text before the first ``\\n`` (only ``\\n`` splits; ``\\r`` and U+2028 do not), stripped."""
    return py_strip(F.substring_index(col(c), "\n", 1))


def drop_prefix_ci(c, prefix: str = ANSWER_PREFIX) -> Column:
    """Remove one leading ``prefix`` compared case-insensitively, then strip."""
    c = col(c)
    n = len(prefix)
    return F.when(
        F.lower(F.substring(c, 1, n)) == F.lit(prefix.lower()),
        py_strip(F.substring(c, F.lit(n + 1), F.length(c))),
    ).otherwise(c)


def clean_answer(c) -> Column:
    """strip -> first line, stripped -> one leading ``answer:`` (any case) removed, stripped."""
    return drop_prefix_ci(first_line(py_strip(c)))
