"""A catalogue of prompts by name; {text}, {source} and {output} are filled in by columns."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CATALOGUE = {
    "level": 'Which level (<A1, A1, A2, B1, B2+, or NA if none fits) does this English text have? Answer as JSON: {"level": "..."}\n\n{text}',
    "verdict": 'Rate how well OUTPUT rewrites SOURCE. Answer as JSON: {"f": 1-5 for facts kept, "h": 1-5 for nothing invented, "lvl": level of OUTPUT}\n\nSOURCE\n{source}\n\nOUTPUT\n{output}',
    "rewrite": "Rewrite this text in plain English for a learner at level A2.\n\n{text}",
}


def prompt(name: str) -> str:
    if name not in CATALOGUE:
        raise KeyError(f"no prompt {name!r}; there are {', '.join(sorted(CATALOGUE))}")
    return CATALOGUE[name]


def filled(name: str, **columns: Column) -> Column:
    out = F.lit(prompt(name))
    for key, column in columns.items():
        out = F.replace(out, F.lit("{" + key + "}"), F.coalesce(column, F.lit("")))
    return out
