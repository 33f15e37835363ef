"""Small results as Markdown; whatever is rendered here has already been computed as a DataFrame of a few rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from disfluo.functions import lexicon as L

LABELS = dict(zip(L.TYPES, ("Filled pause", "Repetition", "Substitution", "Restart")))


def markdown(df: DataFrame, order: list[str], digits: int = 3, most: int = 10_000) -> str:
    """A table in the order of the columns named; one of more than ``most`` rows is no report and raises."""
    rows = df.orderBy(*order).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report holds tables of at most {most} rows")
    show = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    head = [LABELS.get(c.removeprefix("mix_").removeprefix("rate_"), c) if c.startswith(("mix_", "rate_")) else c for c in df.columns]
    lines = ["| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    return "\n".join(lines + ["| " + " | ".join(show(v) for v in r) + " |" for r in rows])


def qualitative(df: DataFrame, level: str = "asked_level") -> str:
    """Scripts (utt_id, clean) with what is said at each level below them."""
    out, last = [], None
    for r in df.orderBy("utt_id", level).collect():  # as many as someone reads
        if r["utt_id"] != last:
            out += ["", f"**{len([x for x in out if x.startswith('**')]) + 1}.** `{r['clean']}`", ""]
            last = r["utt_id"]
        out.append(f"    d{r[level]}  {r['spoken']}")
    return "\n".join(out[1:])
