"""License scans by diagonal voting.

A template is a license notice or phrase as a word sequence. All rolling word k-gram hashes of the
whole corpus meet the templates' k-gram positions in a Spark join; a match at document word p and
template word q votes for the diagonal p - q. Votes are counted per document, template and
diagonal; diagonals up to ``drift`` apart are merged (words put in or left out shift the rest of a
notice); a merged group is a span if it is verified: a phrase has all its k-grams on one diagonal, a
notice at least ``least_cover`` of its k-grams, within a stretch not longer than 1.5 times the notice.

Phrases vote with 2-grams, notices with 5-grams; votes compare 64-bit hashes, so two different k-grams vote alike with probability 2^-64. One more row per document passes through the join
and carries its word count, so texts are read once. The templates are a fixed list, so their side
of the join has a fixed size (some thousand rows) and is broadcast; no document's side is shuffled
before votes are counted, and counting starts before the shuffle.

Defined results: a null or empty text has no words, no places and empty labels; repeated rows are scanned each; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from burrow.llm.textual import WordHashes, alnum_words, column, per_worker, prepare, rolling

PHRASE_K, NOTICE_K = 2, 5
#: The hash of the row that carries a document's word count through the join.
_CARRIER = 0x5A17
#: Hashes in one array, and in one batch sent from Python: a very long text comes in pieces.
PIECE, SENT = 1 << 16, 1 << 20


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrase: bool = False

    @property
    def words(self) -> list[bytes]:
        return alnum_words(self.text.encode())


# Phrases and labels that results must use.
PHRASES = (
    Template("gpl", "gnu general public license", True),
    Template("apache", "apache license", True),
    Template("cc-by", "cc by", True),
    Template("mit", "mit license", True),
)

# Notices of public licenses.
NOTICES = (
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    Template("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or at your option any later version"),
    Template("lgpl", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    Template("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    Template("zlib", "This software is provided as is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike International License"),
)


def _grams(text: str, k: int, hashes: WordHashes) -> np.ndarray:
    """Signed k-gram hashes; k takes part, so grams of different lengths never meet."""
    return (rolling(hashes.of(text.encode()), k) ^ np.uint64(k)).view(np.int64)


def positions(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """gram, template, at, k, grams (of the template), words: one row per k-gram position, and the carrier's."""
    hashes = WordHashes("alnum")
    rows = [(_CARRIER, -1, 0, 0, 0, 0)]
    for i, t in enumerate(templates):
        k = PHRASE_K if t.phrase else NOTICE_K
        g = _grams(t.text, k, hashes).tolist()
        rows += [(h, i, at, k, len(g), len(t.words)) for at, h in enumerate(g)]
    return spark.createDataFrame(rows, "gram long, template int, at int, k int, grams int, words int")


def spans(docs: DataFrame, templates: tuple[Template, ...], drift: int = 3, least_cover: float = 0.5) -> DataFrame:
    """row, doc_id, n_words, template, first, last (words), cover: one row per verified span; template -1 for each document once."""
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), column(docs, "doc_id", "long"), column(docs, "text", "string"))
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("start", pa.int64()), ("grams", pa.list_(pa.int64()))])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = per_worker("alnum hashes", lambda: WordHashes("alnum"))
        held: list[tuple] = []  # row, doc_id, words, the piece's start, its hashes

        def sent() -> pa.RecordBatch:
            ends = np.concatenate([[0], np.cumsum([len(h[4]) for h in held])]).astype(np.int32)
            grams = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([h[4] for h in held]) if held else np.empty(0, np.int64), pa.int64()))
            columns = [pa.array([h[i] for h in held], pa.int64()) for i in range(4)]
            held.clear()
            return pa.RecordBatch.from_arrays([*columns, grams], schema=schema)

        for b in batches:
            size = 0
            for row, key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist()):
                w = hashes.of(text)
                held.append((row, key, len(w), 0, np.array([_CARRIER])))
                for k in (PHRASE_K, NOTICE_K):
                    g = (rolling(w, k) ^ np.uint64(k)).view(np.int64)
                    for start in range(0, len(g), PIECE):
                        held.append((row, key, len(w), start, g[start : start + PIECE]))
                        size += len(held[-1][4])
                        if size >= SENT:
                            yield sent()
                            size = 0
            yield sent()

    all_grams = rows.mapInArrow(hashed, "row long, doc_id long, n_words long, start long, grams array<long>")
    each = all_grams.select("row", "doc_id", "n_words", "start", F.posexplode("grams").alias("pos", "gram"))
    met = each.join(F.broadcast(positions(spark, templates)), "gram")
    word = F.col("start") + F.col("pos")
    key = ["row", "doc_id", "n_words", "template", "grams", "words"]
    votes = (
        met.withColumn("word", F.when(F.col("template") < 0, F.lit(0)).otherwise(word))
        .withColumn("diagonal", F.col("word") - F.col("at"))
        .groupBy(*key, "k", "diagonal")
        .agg(F.count("*").alias("votes"), F.min("word").alias("first"), (F.max("word") + F.first("k") - 1).alias("last"))
    )
    # phrases stay on one diagonal; notices' diagonals merge with neighbours
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(along)
    runs = votes.withColumn("new", F.coalesce(((gap > drift) | (F.col("k") == PHRASE_K)).cast("int"), F.lit(1)))
    runs = runs.withColumn("run", F.sum("new").over(along))
    merged = runs.groupBy(*key, "k", "run").agg(F.sum("votes").alias("votes"), F.min("first").alias("first"), F.max("last").alias("last"))
    cover = F.when(F.col("template") < 0, F.lit(0.0)).otherwise(F.least(F.col("votes") / F.col("grams"), F.lit(1.0)))
    whole = F.when(F.col("k") == PHRASE_K, F.col("votes") == F.col("grams")).otherwise((cover >= least_cover) & (F.col("last") - F.col("first") < 1.5 * F.col("words")))
    return merged.where((F.col("template") < 0) | whole).select("row", "doc_id", "n_words", "template", "first", "last", cover.alias("cover"))


def scan(docs: DataFrame, phrases: tuple[Template, ...] = PHRASES, notices: tuple[Template, ...] = NOTICES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score per row.

    Base columns are about phrases, labels about both; score is the best cover of any template.
    """
    templates = (*phrases, *notices)
    found = spans(docs, templates)
    base = (F.col("template") >= 0) & (F.col("template") < len(phrases))
    names = F.array(*(F.lit(t.label) for t in templates))
    label = F.when(F.col("template") >= 0, F.get(names, F.col("template")))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return (
        found.groupBy("row", "doc_id", "n_words")
        .agg(
            F.count(F.when(base, 1)).alias("n_base"),
            F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
            F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
            joined(F.when(base, label)).alias("base_labels"),
            joined(label).alias("labels"),
            F.max("cover").alias("score"),
        )
        .drop("row")
    )
