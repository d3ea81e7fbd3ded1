"""Column functions on code, labels, days, ids and prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters at which a text is split into lines.
LINE_ENDS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"
FENCE = "(?is)```(?:python|py)\\s*(.*?)```"


def strip(c: Column) -> Column:
    """Without white space at either end, Unicode white space included."""
    return F.regexp_replace(c, "(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$", "")


def clean_code(c: Column) -> Column:
    """Lines without trailing white space, the whole without blank ends."""
    lines = F.transform(F.split(F.regexp_replace(c, "\r\n", "\n"), LINE_ENDS, -1), lambda x: F.regexp_replace(x, "(?U)[\\s\\x1c-\\x1f]+$", ""))
    return strip(F.array_join(lines, "\n"))


def extract_code(c: Column) -> Column:
    """The first fenced block tagged python or py, else the whole text; stripped."""
    return strip(F.when(c.rlike(FENCE), F.regexp_extract(c, FENCE, 1)).otherwise(c))


def normalise_day(c: Column) -> Column:
    """Two digits without a leading ``day`` or ``d``; longer values stay as they are."""
    bare = F.regexp_replace(F.lower(strip(c.cast("string"))), "^(day|d)", "")
    return F.when(F.length(bare) < 2, F.lpad(bare, 2, "0")).otherwise(bare)


def normalise_year(c: Column) -> Column:
    year = strip(c.cast("string"))
    return F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)


def y_llm(repo: Column) -> Column:
    """1 for machine code: a human sample names its repository."""
    return repo.isNull().cast("int")


def y_human(label: Column) -> Column:
    return (label == "human").cast("int")


GROUP_MODES = ("problem", "author_like", "strict")


def group_id(mode: str) -> Column:
    """The leakage group of a sample."""
    if mode not in GROUP_MODES:
        raise ValueError(f"unknown group mode {mode!r}")
    problem = F.concat_ws("_", "year", "day")
    text = lambda c, default="": F.coalesce(F.col(c), F.lit(default))
    human = F.concat_ws("_", F.lit("human"), text("author"))
    machine = F.concat_ws("_", F.lit("llm"), text("model", "unknown" if mode == "strict" else ""), text("code_variant"), text("style_variant"))
    who = F.when(F.col("repo").isNotNull(), human).otherwise(machine)
    return {"problem": problem, "author_like": who, "strict": F.concat_ws("_", problem, who)}[mode]


def job_id() -> Column:
    mode = F.when(F.col("use_comp_programming"), "comp").otherwise("normal")
    return F.concat_ws("@", "model", F.col("year").cast("string"), F.col("day").cast("string"), "code_variant", "style_variant", mode)


#: Fixed value: the prompt around a problem and its two instructions.
PROMPT = """You are solving a programming problem.

    OUTPUT FORMAT:
    - Output ONLY Python code
    - No markdown
    - No explanations

    BEGIN PROBLEM
    {problem}
    END PROBLEM

    BEGIN INSTRUCTIONS
    {code_variant}
    {style_variant}
    END INSTRUCTIONS

    Now write the solution."""


def build_prompt(problem: Column, code_variant: Column, style_variant: Column) -> Column:
    head, rest = PROMPT.split("{problem}")
    middle, rest = rest.split("{code_variant}")
    gap, tail = rest.split("{style_variant}")
    return F.concat(F.lit(head), problem, F.lit(middle), code_variant, F.lit(gap), style_variant, F.lit(tail))


def order_key(seed: int, *columns: str | Column) -> Column:
    """The order of a seeded shuffle: the same on every cluster and in SQL."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c for c in columns]))


#: Tokens, and characters of tokens, that carry no information.
LOW_INFORMATION = ["{", "}", "(", ")", "[", "]", ":", ";", ",", ".", "#"]
OPERATOR_CHARACTERS = "_-=+*/<>!&|"


def informative(token: Column, low: list[str] = LOW_INFORMATION) -> Column:
    return ~strip(token).rlike("^[_\\-=+*/<>!&|]*$") & ~strip(token).isin(*low)
