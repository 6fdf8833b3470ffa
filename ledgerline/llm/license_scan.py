"""Finding license notices in documents: MinHash bands over overlapping windows, then exact containment."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .dedup import _Codes, _mix

K = 5
#: Least share of a template's shingles that a passage must have.
CONTAINMENT = 0.8
#: Least probability that a window with such a passage shares a band with its template.
RECALL = 0.999
ROWS = 2

_normal = re.compile(r"[^\W_]+").findall

#: Notices as their licenses word them (fixed values).
TEMPLATES = {
    "MIT-release": "Released under the MIT License.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "GPL-3.0-work": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "MIT-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
}


@dataclass(frozen=True)
class Settings:
    """Windows of ``window`` shingles, one every ``stride``, and bands of ``rows`` minima for templates of ``size`` shingles.

    A passage of ``size`` shingles lies whole in some window. If it has ``need`` of the template's
    shingles, the window's Jaccard similarity to it is at least ``least``, and the number of bands makes the
    probability that one of them agrees at least RECALL.
    """

    size: int
    stride: int
    window: int
    rows: int
    bands: int


def settings(size: int, containment: float = CONTAINMENT, recall: float = RECALL) -> Settings:
    stride = max(1, size // 4)
    window = size + stride - 1
    need = math.ceil(containment * size - 1e-9)
    least = need / (window + size - need)
    if least >= 1:
        return Settings(size, stride, window, 1, 1)
    bands = math.ceil(math.log(1 - recall) / math.log(1 - least**ROWS))
    return Settings(size, stride, window, ROWS, bands)


def shingles(codes: np.ndarray) -> np.ndarray:
    out = np.zeros(max(len(codes) - K + 1, 0), dtype=np.uint64)
    for i in range(K):
        out = _mix(out + codes[i : i + len(out)])
    return out


class Index:
    """Templates' shingles and bands; they are few and given by the caller. A template needs at least five words."""

    def __init__(self, templates: dict[str, str], containment: float = CONTAINMENT, seed: int = 7):
        self.codes = _Codes()
        self.sets = {}
        for name, text in templates.items():
            found = shingles(self.codes_of(text))
            if not len(found):
                raise ValueError(f"template {name} has fewer than {K} words")
            self.sets[name] = frozenset(found.tolist())
        self.classes: dict[Settings, list[dict[int, list[str]]]] = {}  # by band, from keys to templates
        for name, own in self.sets.items():
            self.classes.setdefault(s := settings(len(own), containment), [{} for _ in range(s.bands)])
        most = max(s.rows * s.bands for s in self.classes)
        self.seeds = np.random.default_rng(seed).integers(1, 2**31, most, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        for s, bands in self.classes.items():
            for name, own in self.sets.items():
                if len(own) == s.size:
                    least = (self.short(np.array(sorted(own), dtype=np.uint64))[None, :] * self.seeds[: s.rows * s.bands, None]).min(1)
                    for band in range(s.bands):
                        bands[band].setdefault(int(self.join(least[band * s.rows : (band + 1) * s.rows, None])[0]), []).append(name)

    def codes_of(self, text: str | None) -> np.ndarray:
        words = _normal((text or "").lower())
        return np.fromiter(map(self.codes.__getitem__, words), dtype=np.uint64, count=len(words))

    @staticmethod
    def short(found: np.ndarray) -> np.ndarray:
        """32 bits are enough to order shingles by, and twice as fast; what agrees is verified on all 64."""
        return (found >> np.uint64(32)).astype(np.uint32)

    @staticmethod
    def join(rows: np.ndarray) -> np.ndarray:
        out = rows[0].astype(np.uint64)
        for row in rows[1:]:
            out = (out << np.uint64(32)) ^ row
        return out

    def candidates(self, found: np.ndarray) -> set[tuple[str, int, int]]:
        """(template, first shingle, end) of the windows of a stream of shingles that share a band with a template."""
        out = set()
        if not len(found):
            return out
        least: dict[tuple[int, Settings], np.ndarray] = {}
        short = self.short(found)
        for i in range(len(self.seeds)):
            classes = [s for s in self.classes if i < s.rows * s.bands]
            if not classes:
                break
            hashed = short * self.seeds[i]
            for s in classes:
                least[i, s] = _window_least(hashed, s.stride, s.window)
                if (i + 1) % s.rows == 0:
                    band = i // s.rows
                    key = self.join(np.stack([least.pop((b, s)) for b in range(band * s.rows, i + 1)]))
                    wanted = self.classes[s][band]
                    for w in np.flatnonzero(np.isin(key, np.array(list(wanted), dtype=np.uint64))).tolist():
                        for name in wanted[int(key[w])]:
                            out.add((name, w * s.stride, min(w * s.stride + s.window, len(found))))
        return out


def _window_least(hashed: np.ndarray, stride: int, window: int) -> np.ndarray:
    """The least of each window: of blocks of ``stride``, then of the blocks that a window has."""
    if stride == 1 and window == 1:
        return hashed
    blocks = -(-len(hashed) // stride)
    padded = np.full(blocks * stride, 2**32 - 1, dtype=np.uint32)
    padded[: len(hashed)] = hashed
    span, rest = divmod(window, stride)
    least = padded[::stride].copy()
    head = least  # of the first ``rest`` of each block, for a window that ends inside one
    for i in range(1, stride):
        if i == rest:
            head = least.copy()
        np.minimum(least, padded[i::stride], out=least)
    out, have = least, 1
    while have < span:  # of 1, 2, 4, ... blocks, then of two such runs that overlap
        step = min(have, span - have)
        out = np.append(np.minimum(out[:-step], out[step:]), out[-step:]) if step < len(out) else out
        have += step
    if rest and span < blocks:
        out[:-span] = np.minimum(out[:-span], head[span:])
    return out


@lru_cache(4)
def index_of(templates: tuple[tuple[str, str], ...], containment: float) -> Index:
    return Index(dict(templates), containment)


OUT = "license string, containment double, first_word int, end_word int"


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, *, id_col="doc_id", text_col="text", containment: float = CONTAINMENT) -> DataFrame:
    """(id, license, containment, first_word, end_word): for each document and template that it holds, the best
    passage and the words it spans, first of equals.

    Words are lower case, letters and digits only. Null, empty and short texts hold nothing. Repeated
    rows give repeated results. Empty table: no rows. Extra columns are left out.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    given = tuple(templates.items())

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = index_of(given, containment)
        for batch in batches:
            for at in range(0, len(batch), 100):  # as much as a processor's cache holds
                part = batch.iloc[at : at + 100]
                out, ids = [], part["id"].to_numpy()
                codes = [index.codes_of(t if isinstance(t, str) else None) for t in part["text"]]
                ends = np.cumsum([len(c) for c in codes])
                # Documents follow each other in one stream; a window over two of them is only a candidate.
                found = shingles(np.concatenate(codes)) if codes else np.zeros(0, dtype=np.uint64)
                best: dict[tuple[int, str], tuple] = {}
                for name, first, end in index.candidates(found):
                    own = index.sets[name]
                    for doc in range(int(np.searchsorted(ends, first, side="right")), len(codes)):
                        start = int(ends[doc] - len(codes[doc]))
                        if start >= end:
                            break
                        lo, hi = max(first, start), min(end, int(ends[doc]) - K + 1)
                        here = found[lo:hi].tolist() if hi > lo else []
                        share = len(own.intersection(here)) / len(own)
                        if share >= containment - 1e-9:
                            places = [lo + i for i, x in enumerate(here) if x in own]
                            rank = (-share, places[0] - start, places[-1] + K - start)
                            best[doc, name] = min(best.get((doc, name), rank), rank)
                out = [(name, -share, a, b) for (_, name), (share, a, b) in best.items()]
                frame = pd.DataFrame(out, columns=["license", "containment", "first_word", "end_word"])
                frame.insert(0, "id", ids[[doc for doc, _ in best]] if best else pd.array([], dtype=ids.dtype))
                yield frame

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return picked.mapInPandas(rows, f"id {kind}, {OUT}").withColumnRenamed("id", id_col)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
