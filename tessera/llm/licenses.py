"""License scans by diagonal voting.

Every run of k words of every text is hashed, and Spark joins the hashes to those of the templates, a small fixed table.
A match at word i of a text and word j of a template votes for the diagonal i - j; a copy of the template has its votes
on one diagonal, or on neighbouring ones where words were put in or left out. Votes are summed by diagonal, diagonals at
most ``GAP`` apart whose places follow each other are merged, and those with enough votes become spans, which are
verified word by word in the text. Phrases of a few words are templates too, of which every word must stand in place.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WordHash, id_and_text, rolling, signed, stored, texts_of

#: Phrases and their labels, which any text with the phrase carries.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Passages of public licences and their notices, with the labels of the texts that hold them.
PASSAGES = (
    ("Licensed under the Apache License, Version 2.0", "apache-2.0"),
    ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at', "apache-2.0"),
    ("This work is licensed under the GNU General Public License, version 3", "gpl-3.0"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gpl-3.0"),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "gpl-2.0"),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "lgpl"),
    ("You should have received a copy of the GNU Affero General Public License along with this program", "agpl"),
    ("Released under the MIT License", "mit"),
    ('Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software', "mit"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd"),
    ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "bsd-3-clause"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mpl-2.0"),
    ("This is free and unencumbered software released into the public domain", "unlicense"),
    ("Licensed under CC BY-NC 4.0", "cc-by-nc-4.0"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by-4.0"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa-4.0"),
)
#: Words in a run for phrases and for passages; passages of fewer words than the latter can't be templates.
K_PHRASE, K_PASSAGE = 2, 4
#: Diagonals so far apart merge; a merged span needs this share of a template's votes, and then of its words in place.
GAP, VOTES, COVER = 3, 0.4, 0.7
#: Texts with candidate spans up to which these are sent to the texts, about 200 bytes each; of more both sides are dealt.
FEW = 100_000
#: Rows of one id and text that one task writes.
CHUNK = 10_000
#: What stands in the place of a hash in the one row that each document always gives.
HEAD = -1
SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
FOLD = bytes.maketrans(bytes(range(0x41, 0x5B)) + bytes(c for c in SEPARATORS if not 0x41 <= c < 0x5B), bytes(range(0x61, 0x7B)) + b" " * (len(SEPARATORS) - 26))


def words_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of characters beyond ASCII, A-Z in lower case."""
    return (text or "").encode("utf-8", "replace").translate(FOLD).split()


class Templates:
    """The phrases and passages as word lists, with the k of each."""

    def __init__(self, phrases: Iterable[tuple[str, str]] = PHRASES, passages: Iterable[tuple[str, str]] = PASSAGES):
        self.words, self.labels, self.k, self.base = [], [], [], []
        for source, k in ((phrases, K_PHRASE), (passages, K_PASSAGE)):
            for text, label in source:
                self.words.append(words_of(text))
                self.labels.append(label)
                self.k.append(k)
                self.base.append(k == K_PHRASE)
                if len(self.words[-1]) < k:
                    raise ValueError(f"a template of fewer than {k} words: {text}")

    def rows(self) -> list[tuple[int, int, int, int]]:
        """(hash, template, place, k) of every run of words; template -1 stands for the documents' own rows."""
        hashes, out = WordHash(), [(HEAD, -1, 0, 0)]
        for t, (words, k) in enumerate(zip(self.words, self.k, strict=True)):
            out += [(int(h), t, j, k) for j, h in enumerate(signed(rolling(hashes.of(words), k)))]
        return out


def hashed(docs: DataFrame) -> DataFrame:
    """doc_id, tag, n_words, at2 (how many hashes of phrases' k) and the hashes of all runs of words of ``docs`` (doc_id, text, tag)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        head = np.array([HEAD], np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                counts, short, arrays = [], [], []
                for text in texts_of(part):
                    words = hashes.of(words_of(text))
                    two = signed(rolling(words, K_PHRASE))
                    counts.append(len(words))
                    short.append(len(two))
                    arrays.append(np.concatenate([head, two, signed(rolling(words, K_PASSAGE))]))
                ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(counts, pa.int64()), pa.array(short, pa.int32()), lists], ["doc_id", "tag", "n_words", "at2", "hashes"])

    return docs.mapInArrow(run, "doc_id long, tag long, n_words long, at2 int, hashes array<long>")


def votes(docs: DataFrame, templates: Templates) -> DataFrame:
    """doc_id, tag, template, diagonal, n_words, places (the text's words where runs matched) and rows (of this id and text)."""
    grams = docs.sparkSession.createDataFrame(templates.rows(), "hash long, template int, place int, k int")  # fixed, small
    each = hashed(docs).select("doc_id", "tag", "n_words", "at2", F.posexplode("hashes").alias("pos", "hash"))
    met = each.join(F.broadcast(grams), "hash").where("k = CASE WHEN pos = 0 THEN 0 WHEN pos <= at2 THEN %d ELSE %d END" % (K_PHRASE, K_PASSAGE))
    at = F.col("pos") - 1 - F.when(F.col("k") == K_PASSAGE, F.col("at2")).otherwise(F.lit(0))
    met = met.withColumn("word", at.cast("int")).withColumn("diagonal", F.col("word") - F.col("place"))
    return met.groupBy("doc_id", "tag", "template", "diagonal").agg(F.max("n_words").alias("n_words"), F.array_sort(F.collect_set("word")).alias("places"), F.sum(F.when(F.col("template") < 0, 1).otherwise(0)).alias("rows"))


def merged(by_diagonal: DataFrame, templates: Templates) -> DataFrame:
    """One row for each text: doc_id, tag, n_words, rows and its candidate spans (template, diagonals, start, end)."""
    spark = by_diagonal.sparkSession
    need = spark.createDataFrame([(t, 1 if base else GAP + 1, len(w) - k + 1, (1.0 if base else VOTES), k) for t, (w, k, base) in enumerate(zip(templates.words, templates.k, templates.base, strict=True))], "template int, apart int, most int, share double, k int")
    rows = by_diagonal.withColumns({"first": F.array_min("places"), "last": F.array_max("places")}).join(F.broadcast(need), "template", "left")
    w = Window.partitionBy("doc_id", "tag", "template").orderBy("diagonal")
    new = (F.col("diagonal") - F.lag("diagonal").over(w) >= F.col("apart")) | (F.col("first") - F.lag("last").over(w) > 4 * F.col("most"))
    rows = rows.withColumn("new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spans = rows.groupBy("doc_id", "tag", "template", "run").agg(F.sum(F.size("places")).alias("votes"), F.collect_list("diagonal").alias("diagonals"), F.min("first").alias("start"), (F.max("last") + F.first("k")).alias("end"), F.max("n_words").alias("n_words"), F.max("rows").alias("rows"), F.first("most").alias("most"), F.first("share").alias("share"))
    span = F.when((F.col("template") >= 0) & (F.col("votes") >= F.col("share") * F.col("most")), F.struct("template", "start", "end", F.array_sort("diagonals").alias("diagonals")))
    return spans.groupBy("doc_id", "tag").agg(F.max("n_words").alias("n_words"), F.max("rows").alias("rows"), F.collect_list(span).alias("spans"))


def verified(words: list[bytes], templates: Templates, template: int, diagonals: list[int]) -> float:
    """The share of a template's words that stand on any of the diagonals, in the template's order."""
    want, count, last = templates.words[template], 0, -1
    for j, word in enumerate(want):
        at = min((i for d in diagonals if last < (i := d + j) < len(words) and words[i] == word), default=None)
        if at is not None:
            count, last = count + 1, at
    return count / len(want)


FOUND = "array<struct<label:string,start:long,end:long,share:double>>"
RESULT = f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans {FOUND}"


def license_scan(docs: DataFrame, phrases: Iterable[tuple[str, str]] = PHRASES, passages: Iterable[tuple[str, str]] = PASSAGES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans of every row of ``docs``.

    ``n_base`` counts all places of the phrases, overlapping ones too; first_word and last_word are their least and
    greatest start (null: none). ``labels`` has the passages' labels as well. ``score`` is 1 where a phrase stands, else
    the greatest verified share of a passage, 0 without any. ``spans`` are the verified places of phrases and passages
    (label, first word, word after the last, share of the template's words), by place. Null and empty texts have no words
    and no spans. Repeated rows return as often as they stand; rows of one id, or of none, with different texts are texts
    of their own. A text's length isn't bounded, but one text is handled by one task. Other columns are ignored; an empty
    table gives an empty one.
    """
    docs = id_and_text(docs).withColumn("tag", F.xxhash64("text"))
    templates = Templates(phrases, passages)
    sent = docs.sparkSession.sparkContext.broadcast(templates)
    found = stored(merged(votes(docs, templates), templates), "licenses")
    plain = found.where(F.size("spans") == 0)
    spans = found.where(F.size("spans") > 0)
    none = plain.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_base"), F.lit(None).cast("long").alias("first_word"), F.lit(None).cast("long").alias("last_word"), F.lit("").alias("base_labels"), F.lit("").alias("labels"), F.lit(0.0).alias("score"), F.array().cast(FOUND).alias("spans"), "rows")
    # One text for each candidate: rows of the same id and text differ in nothing, so any of them will do.
    few = spans.limit(FEW + 1).count() <= FEW
    same = F.col("s.doc_id").eqNullSafe(F.col("d.doc_id")) & (F.col("s.tag") == F.col("d.tag"))
    texts = docs.alias("d").join((F.broadcast(spans) if few else spans).alias("s"), same).select("s.*", "d.text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = sent.value
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                text = row["text"] or ""
                words, starts, base, labels, score, places = words_of(text), [], set(), set(), 0.0, []
                for s in row["spans"]:
                    k = s["template"]
                    if t.base[k]:
                        good = [d for d in s["diagonals"] if words[d : d + len(t.words[k])] == t.words[k] and d >= 0]
                        starts += good
                        places += [(d, d + len(t.words[k]), t.labels[k], 1.0) for d in good]
                        if good:
                            base.add(t.labels[k])
                            score = 1.0
                    elif (share := verified(words, t, k, s["diagonals"])) >= COVER:
                        labels.add(t.labels[k])
                        score = max(score, share)
                        places.append((s["start"], s["end"], t.labels[k], share))
                out.append({"doc_id": row["doc_id"], "n_words": row["n_words"], "n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None), "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | labels)), "score": score, "spans": [{"label": x, "start": a, "end": b, "share": y} for a, b, x, y in sorted(places)], "rows": row["rows"], "tag": row["tag"]})
            yield pa.RecordBatch.from_pylist(out, schema=ARROW)

    checked = texts.mapInArrow(run, RESULT + ", rows long, tag long").dropDuplicates(["doc_id", "tag"]).drop("tag")
    both = none.unionByName(checked)
    once = both.where("rows = 1")
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / CHUNK)))
    more = both.where("rows > 1").withColumn("chunk", chunk).repartition("doc_id", "chunk")
    more = more.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(CHUNK).cast("long"), F.col("rows") - F.col("chunk") * CHUNK)))).drop("_", "chunk")
    return once.unionByName(more).drop("rows")


KINDS = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), FOUND: pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))}
ARROW = pa.schema([(c.split()[0], KINDS[c.split()[1]]) for c in (RESULT + ", rows long, tag long").split(", ")])
