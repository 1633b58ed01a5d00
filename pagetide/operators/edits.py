"""Page edits as token rewrites: remove, replace, add, modify."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetide.functions import html as H
from pagetide.operators.elements import elements, page_tokens_of, spread_pages
from pagetide.operators.selectors import match, needs_tree


@dataclass(frozen=True)
class Edit:
    op: str
    selector: str
    content: str | None = None
    attributes: Mapping[str, str] = field(default_factory=dict)
    position: str = "append"


def _escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def _new_tag(token: Column, names: Column, values: Column, attributes: Mapping[str, str]) -> Column:
    kept = F.filter(
        F.arrays_zip(names.alias("n"), values.alias("v")), lambda a: ~a["n"].isin(*attributes)
    )
    quoted = F.transform(
        kept,
        lambda a: F.concat(
            F.lit(" "), a["n"], F.lit('="'),
            F.replace(F.replace(a["v"], F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")),
            F.lit('"'),
        ),
    )
    added = "".join(f' {k}="{_escape(v).replace(chr(34), "&quot;")}"' for k, v in attributes.items())
    return F.concat(
        F.regexp_extract(token, r"^(<[A-Za-z][A-Za-z0-9:-]*)", 1), F.array_join(quoted, ""),
        F.lit(added + ">"),
    )


def _apply(pages: DataFrame, edit: Edit, key: str) -> DataFrame:
    # Every edit leaves its pages by key, as edit_pages dealt them.
    els = match(elements(pages, key, tree=needs_tree([edit.selector]), spread=False), [edit.selector], key)
    target = F.struct("open", "close", "tag", "token", "attr_names", "attr_values")
    page = els.groupBy(key).agg(
        page_tokens_of().alias("toks"),
        F.collect_list(F.when(F.size("hits") > 0, target)).alias("xs"),
    )
    no_cut, no_text = F.lit(-1), F.lit(None).cast("string")

    def row(at, order: int, text, cut) -> Column:
        return F.struct(at.alias("at"), F.lit(order).alias("ord"), text.alias("token"), cut.alias("cut"))

    def marks(x: Column) -> Column:
        count = F.size("toks")
        shut = F.get(F.col("toks"), x["close"] - 1)
        own_end = (x["close"] <= count) & (
            F.lower(F.regexp_extract(F.coalesce(shut, F.lit("")), r"^</([A-Za-z][A-Za-z0-9:-]*)", 1)) == x["tag"]
        )
        last_inner = F.when(x["close"] == x["open"], x["open"]).otherwise(
            F.least(x["close"] - 1, count)
        )
        last = F.when(own_end, x["close"]).otherwise(last_inner)
        new = F.lit(edit.content).cast("string")
        out: list[Column] = []
        if edit.op == "remove":
            out = [row(x["open"], 1, no_text, last)]
        elif edit.op == "replace" and edit.content:
            out = [row(x["open"], 0, new, no_cut), row(x["open"], 1, no_text, last)]
        elif edit.op == "add" and edit.content:
            spot = {
                "before": (x["open"], 4), "after": (last, 6), "prepend": (x["open"], 6),
            }.get(edit.position, (last_inner, 7))
            out = [row(spot[0], spot[1], new, no_cut)]
        elif edit.op == "modify":
            if edit.attributes:
                tag = _new_tag(x["token"], x["attr_names"], x["attr_values"], edit.attributes)
                out += [row(x["open"], 0, tag, no_cut), row(x["open"], 1, no_text, x["open"])]
            if edit.content:
                out += [
                    row(x["open"], 6, F.lit(_escape(edit.content)), no_cut),
                    row(x["open"], 7, no_text, last_inner),
                ]
        return F.array(*out) if out else F.array().cast(
            "array<struct<at:int,ord:int,token:string,cut:int>>"
        )

    # The empty row at 0 keeps a page that loses everything.
    start = F.array(row(F.lit(0), 5, F.lit(""), no_cut))
    own = F.transform("toks", lambda t, i: row(i + 1, 5, t, no_cut))
    rows = page.select(key, F.inline(F.concat(start, own, F.flatten(F.transform("xs", marks)))))
    along = Window.partitionBy(key).orderBy("at", "ord")
    gone = F.max("cut").over(along.rowsBetween(Window.unboundedPreceding, -1))
    # Ends inside a removed span vanish with it; marks at its own start survive.
    kept = rows.withColumn("gone", F.coalesce(gone, F.lit(-1))).where(
        (F.col("ord") >= 6) & (F.col("at") >= F.col("gone")) | (F.col("at") > F.col("gone"))
    )
    return kept.where("token is not null").groupBy(key).agg(
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct("at", "ord", "token"))), lambda r: r["token"]
            ),
            "",
        ).alias("html")
    )


def edit_pages(
    pages: DataFrame, edits: Sequence[Edit], key: str = "page_id",
    cut: Callable[[DataFrame], DataFrame] | None = None, cut_every: int = 4,
) -> DataFrame:
    """Apply edits in order; each sees the result of those before it.

    Every edit parses anew, so the plan grows with the list. For long lists pass ``cut``, for
    instance ``DataFrame.checkpoint`` or a function that writes a table and reads it: it is
    called after every ``cut_every`` edits but the last. Without it the plan is one piece.
    """
    out = spread_pages(pages, key)
    for done, edit in enumerate(edits, start=1):
        out = _apply(out, edit, key)
        if cut is not None and done % cut_every == 0 and done < len(edits):
            out = spread_pages(cut(out), key)
    return out
