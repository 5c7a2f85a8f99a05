"""What a caller is answered: the view with what it saved, and figures as JSON."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The answers' wording and JSON names.
NOTHING = "No matching context found. If you expected code here, read the relevant file directly."
NOTE = 'Lines shown are real; "// name (kind, lines …): signature" entries are other symbols in the file, collapsed — request them by name if you need their bodies.'
NAMES = {"last_updated": "lastUpdated", "naive_tokens": "naiveTokens", "targeted_tokens": "targetedTokens", "saved_tokens": "savedTokens", "saved_pct": "savedPct", "first_ts": "firstTs", "last_ts": "lastTs"}


def answer(context: Column, naive: Column, targeted: Column, saved: Column) -> Column:
    """The view, then the tokens that it saved; without a view, that nothing was found."""
    foot = F.format_string(footer("%1$d", "%2$d", "%3$d"), *[F.coalesce(n, F.lit(0)).cast("long") for n in (naive, targeted, saved)])
    return F.when(F.coalesce(context, F.lit("")) == "", F.lit(NOTHING)).otherwise(F.concat(context, foot))


def footer(naive: int | str, targeted: int | str, saved: int | str) -> str:
    """What follows the view."""
    return f"\n\n---\n~{saved} tokens saved this call ({naive} naive -> {targeted} targeted). {NOTE}"


def as_json(row: DataFrame, indent: int | None = 2) -> str:
    """The one row of a table of figures as JSON; times in ISO form, UTC."""
    found = row.first()
    values = {} if found is None else found.asDict()
    named = {NAMES.get(k, k): v.isoformat() if hasattr(v, "isoformat") else v for k, v in values.items()}
    return json.dumps(named, indent=indent)
