"""Personal data: fixed patterns, and contexts learned from what they find that lead to more."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]
#: A context counts if at least so many different identifiers of a kind were seen in it, ...
SUPPORT = 3
#: ... and a form is accepted at this confidence; accepted forms vouch for further contexts.
ACCEPT = 0.75

_local = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_host = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_card = re.compile(r"[0-9](?:[ -]?[0-9])++")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_digits = re.compile(r"[0-9]")

#: Looser shapes that only a learned context can make personal data.
_loose = {
    "email": re.compile(r"[^\s@<>()\[\],;]{1,64}(?:@| ?[(\[]at[)\]] ?)[^\s@<>()\[\],;]{1,64}"),
    "ip": re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9a-fA-F]{0,4}:){3,7}[0-9a-fA-F]{1,4}(?![0-9A-Za-z:])|(?<![0-9.])[0-9]{1,4}(?:\.[0-9]{1,4}){3}(?![0-9])"),
    "card": re.compile(r"(?<![0-9+])[0-9](?:[ -]?[0-9]){11,18}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+])\(?[0-9]{2,5}\)?(?:[ .-][0-9]{2,5}){1,4}(?![0-9])"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern's leftmost matches, found from each @ so that long words cost no more than their length."""
    end, at = 0, text.find("@")
    last = -1
    while at >= 0:
        floor = max(end, last + 1)
        start = floor + len(text[floor:at].rstrip(_local))
        if start < at and (host := _host.match(text, at + 1)):
            end = host.end()
            yield start, end
        last, at = at, text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """By kind as listed, then start; code points, end exclusive."""
    out: list[Span] = []
    if "@" in text:
        out += [("email", a, b) for a, b in _emails(text)]
    if _digits.search(text):
        out += [("ip", *m.span()) for m in _ip.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split("."))]
        for m in _card.finditer(text):
            if m.end() - m.start() <= 40 and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _phone.finditer(text) if 8 <= len(_digits.findall(m[0])) <= 15]
    return out


def loose_spans(text: str, base: list[Span]) -> list[Span]:
    """Spans of a looser shape that touch no base span."""
    out: list[Span] = []
    starts, ends = [], []  # of stretches that base spans cover, apart from each other and in order
    for _, a, b in sorted(base, key=lambda s: s[1:]):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    for kind, pattern in _loose.items():
        if kind == "email" and "@" not in text and "at)" not in text and "at]" not in text:
            continue
        for m in pattern.finditer(text):
            near = bisect_left(starts, m.end()) - 1  # the last stretch that starts before the match ends
            if near < 0 or ends[near] <= m.start():
                if kind != "phone" or 7 <= len(_digits.findall(m[0])) <= 15:
                    out.append((kind, *m.span()))
    return out


def form_of(kind: str, found: str) -> str:
    return found.lower() if kind in ("email", "ip") else "".join(_digits.findall(found))


def contexts(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns around a span: two words before, and the words on both sides."""
    shape = lambda w: re.sub(r"[0-9]+", "0", w.lower())
    left = [shape(w) for w in text[max(0, start - 120) : start].split()[-2:]]
    right = [shape(w) for w in text[end : end + 60].split()[:1]] or ["$"]
    left = ["^"] * (2 - len(left)) + left
    return [f"{left[0]} {left[1]} _", f"{left[1]} _ {right[0]}"]


SPAN = "struct<kind:string,start:int,end:int>"
MENTION = "struct<kind:string,start:int,end:int,form:string,seed:boolean,contexts:array<string>>"


def mentions(docs: DataFrame, text_col: str, keep_text: bool) -> DataFrame:
    """``docs`` (without the text, unless it is to be kept) with row, its base spans and all mentions, loose ones too, with their contexts."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if keep_text or f.name != text_col)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            all_base, all_found = [], []
            for text in batch[text_col]:
                text = text if isinstance(text, str) else ""
                base = base_spans(text)
                spans = [(True, s) for s in base] + [(False, s) for s in loose_spans(text, base)]
                all_base.append([{"kind": k, "start": a, "end": b} for k, a, b in base])
                all_found.append([{"kind": k, "start": a, "end": b, "form": form_of(k, text[a:b]), "seed": seed, "contexts": contexts(text, a, b)} for seed, (k, a, b) in spans])
            batch["pii base"], batch["pii mentions"] = all_base, all_found
            yield batch if keep_text else batch.drop(columns=text_col)

    return docs.mapInPandas(rows, f"{schema}, `pii base` array<{SPAN}>, `pii mentions` array<{MENTION}>").withColumn("pii row", F.monotonically_increasing_id())


def learn(found: DataFrame) -> DataFrame:
    """Accepted forms (kind, form) among loose mentions (kind, form, seed, context).

    The graph joins contexts and forms. A context's confidence is the sum of its forms' confidence over their number
    and one, if enough forms of it are sure; a form that is not a seed has one minus the product of its contexts'
    doubts. Sums come from aggregations by context and by form. Confidence only rises, and rounds go on until none does.
    """
    edges = found.groupBy("kind", "context", "form").agg(F.max("seed").alias("seed"))
    useful = edges.groupBy("kind", "context").agg(F.count("*").alias("n"), F.sum(F.col("seed").cast("int")).alias("seeds")).filter("n > seeds").select("kind", "context")
    # Only contexts that some unproven form stands in can accept anything.
    edges = saved(edges.join(useful, ["kind", "context"], "left_semi"), "pii-edges")
    sure = edges.filter("seed").select("kind", "form").distinct().withColumn("p", F.lit(1.0))
    accepted = None
    while True:
        scored = edges.join(sure, ["kind", "form"], "left").withColumn("p", F.coalesce("p", F.lit(0.0)))
        patterns = (
            scored.groupBy("kind", "context")
            .agg((F.sum("p") / (F.count("*") + 1)).alias("c"), F.sum((F.col("p") >= ACCEPT).cast("int")).alias("support"))
            .filter(F.col("support") >= SUPPORT)
            .select("kind", "context", "c")
        )
        forms = edges.filter("not seed").join(patterns, ["kind", "context"]).groupBy("kind", "form").agg((1 - F.exp(F.sum(F.log1p(-F.col("c"))))).alias("p"))
        new = saved(forms.filter(F.col("p") >= ACCEPT), "pii-forms")
        if accepted is None:
            risen = new
        else:
            old = accepted.select("kind", "form", F.col("p").alias("old"))
            risen = new.join(old, ["kind", "form"], "left").filter("old is null or p > old + 1e-9")
        if risen.isEmpty():
            return new.select("kind", "form")
        accepted = new
        sure = edges.filter("seed").select("kind", "form").distinct().withColumn("p", F.lit(1.0)).union(new.select("kind", "form", "p"))


#: Columns that ``find`` makes.
OWN = ["pii row", "pii base", "pii mentions", "pii more", "pii spans"]


def find(docs: DataFrame, *, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``pii base`` and ``pii spans``: arrays of (kind, start, end) by kind as listed, then start.

    The spans hold all base spans and the loose mentions whose form was accepted. Null and empty texts
    have none. Repeated rows have the same spans, and their identifiers count once. Empty table: no
    rows. Other columns are kept, but those of the names used here (OWN) are replaced.
    """
    rows = saved(mentions(docs.drop(*(c for c in OWN if c != text_col)), text_col, keep_text), "pii-mentions")
    each = rows.select("pii row", F.explode("pii mentions").alias("m")).select("pii row", "m.*")
    accepted = learn(each.select("kind", "form", "seed", F.explode("contexts").alias("context")))
    more = each.filter("not seed").join(accepted, ["kind", "form"], "left_semi")
    more = saved(more.groupBy("pii row").agg(F.collect_set(F.struct("kind", "start", "end")).alias("pii more")), "pii-more")
    order = lambda s: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]), s["start"], s["end"], s["kind"])
    everything = F.array_sort(F.transform(F.concat("pii base", F.coalesce("pii more", F.array().cast(f"array<{SPAN}>"))), lambda s: order(s).cast("struct<n:bigint,start:int,end:int,kind:string>")))
    spans = F.transform(everything, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return rows.join(more, "pii row", "left").withColumn("pii spans", spans).drop("pii row", "pii mentions", "pii more")


def digest(spans: str):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with each span of personal data replaced by its kind in brackets. Spans that overlap are
    replaced together, under the kind of the first. Columns of any name are kept."""
    columns = [f"column {i}" for i in range(len(docs.columns))]
    own = columns[docs.columns.index(text_col)]
    schema = ", ".join(f"`{c}` {f.dataType.simpleString()}" for c, f in zip(columns, docs.schema, strict=True))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, spans in zip(batch[own], batch["pii spans"], strict=True):
                parts, at = [], 0
                for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
                    if s["start"] >= at:
                        parts += [text[at : s["start"]], f"[{s['kind'].upper()}]"]
                    at = max(at, s["end"])
                out.append("".join([*parts, text[at:]]) if parts else text)
            batch[own] = out
            yield batch[columns]

    found = find(docs.toDF(*columns), text_col=own).select(*columns, "pii spans")
    return found.mapInPandas(rows, schema).toDF(*docs.columns)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    slim = find(docs, keep_text=False)
    count = lambda kind: F.size(F.filter("pii base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return slim.select("doc_id", *map(count, KINDS), F.sha2(digest("pii base"), 256).alias("base_sha256"), digest("pii spans").alias("spans"))
