"""Checks that a service makes on entry, as filters that keep the rejected rows and say why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrecall.functions.text import ColumnOrName, col
from sparkrecall.schemas import ITEM_TYPES, ROLES

#: The pattern and length of ids. \z, not $: the latter also matches before a final newline.
ID_PATTERN = r"^[A-Za-z0-9][A-Za-z0-9_.:-]*\z"
ID_CHARS = 128


def valid_id(value: ColumnOrName) -> Column:
    v = col(value)
    return F.coalesce(v.rlike(ID_PATTERN) & F.char_length(v).between(1, ID_CHARS), F.lit(False))


def request_reasons() -> Column:
    """Why a request is rejected; an empty array for a valid one."""
    bad_role = F.exists("input", lambda m: ~F.coalesce(m["role"].isin(*ROLES), F.lit(False)))
    bad_item = F.exists("input", lambda m: F.coalesce(F.exists(m["content_items"], lambda x: ~F.coalesce(x["type"].isin(*ITEM_TYPES), F.lit(False))), F.lit(False)))
    checks = (
        (~valid_id("user_id"), "user_id"),
        (~valid_id("session_id"), "session_id"),
        (F.coalesce(F.size("input"), F.lit(0)) < 1, "empty_input"),
        (F.coalesce(bad_role, F.lit(False)), "role"),
        (F.coalesce(bad_item, F.lit(False)), "item_type"),
        (F.coalesce(F.col("recent_rounds_full") <= 0, F.lit(False)), "recent_rounds_full"),
    )
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for bad, name in checks]))


def validate_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """V1: (valid requests, rejected ones with `reasons`)."""
    judged = requests.withColumn("reasons", request_reasons())
    return judged.filter(F.size("reasons") == 0).drop("reasons"), judged.filter(F.size("reasons") > 0)


def valid_scores(hits: DataFrame) -> DataFrame:
    """V2: hits whose score, and importance if there is one, lie in [0, 2]."""
    kept = hits.filter(F.col("score").between(0, 2))
    return kept.filter(F.col("importance").between(0, 2)) if "importance" in hits.columns else kept


def valid_usage(usage: DataFrame) -> DataFrame:
    """V3: rows without a negative counter; a missing one counts as 0."""
    names = ("input_tokens", "output_tokens", "total_tokens")
    return usage.filter(" and ".join(f"coalesce({n}, 0) >= 0" for n in names)).withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in names})


def safe_user_dir(user_id: ColumnOrName) -> Column:
    """V4: true if a folder of this name stays below the base folder: no absolute path, no part that climbs out."""
    v = col(user_id)
    parts = F.filter(F.split(v, "/"), lambda p: (p != "") & (p != "."))
    # the depth after each part may never fall below the base
    depth = F.aggregate(parts, F.array(F.lit(0)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + F.when(p == "..", -1).otherwise(1))))
    return F.coalesce(~v.startswith("/") & ~v.contains("\0") & (F.array_min(depth) >= 0), F.lit(False))
