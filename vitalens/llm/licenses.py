"""License scans by diagonal voting.

Words are runs of digits, letters a-z (A-Z in lower case) and characters beyond ASCII.
All rolling k-gram hashes of the documents are joined to the places of the same k-grams
in the templates.  A match votes for its diagonal, the place in the document less the
place in the template; copied text puts all its votes on one diagonal.

Phrases use k = PHRASE_GRAM.  A diagonal that has a vote for every k-gram of a phrase is a
place where its words stand consecutively.  License texts use k = TEXT_GRAM; diagonals at
most BAND apart are merged, so that inserted or lost words do not break a text, and a
merged span counts if its votes are SHARE of the template's k-grams and DENSITY of its
own words.  A vote is an equality of 64-bit hashes, so a span is verified by its votes.

The template table has a fixed size and is broadcast.  A document sends its k-grams in
pieces of PIECE, so long texts do no harm, and only matches are shuffled.

Null and empty texts have no words, no labels and score 0.  Rows that agree in id and
text are scanned as one document and give one row each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitalens.llm.common import ALNUM, WordHashes, arrow_map, rolling, slices, texts

PHRASE_GRAM, TEXT_GRAM = 2, 6
BAND, SHARE, DENSITY = 8, 0.3, 0.4
PIECE = 8192

# Phrases and their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

# Public license texts and notices, by label.
TEXTS = [
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    (
        "apache",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License.",
    ),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
        "License for more details.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
]


def signed(h: np.ndarray) -> list[int]:
    return h.view(np.int64).tolist()


def templates(phrases, long_texts) -> list[tuple]:
    """(gram, template, place, label, phrase, grams) of every k-gram; row 0 stands for a document itself."""
    hashes, out = WordHashes(), [(0, -1, 0, None, False, 0)]
    for number, (text, label, k) in enumerate([(*p, PHRASE_GRAM) for p in phrases] + [(t, name, TEXT_GRAM) for name, t in long_texts]):
        grams = signed(rolling(hashes.of(text.encode().translate(ALNUM).split()), k))
        out += [(g, number, place, label, number < len(phrases), len(grams)) for place, g in enumerate(grams)]
    return out


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=None, long_texts=None) -> DataFrame:
    """One row per document: doc_id, n_words, places (of phrases: word, label), spans (of
    license texts: first and last word, label, share), in the order of their words."""
    known = templates(PHRASES if phrases is None else phrases, TEXTS if long_texts is None else long_texts)
    table = F.broadcast(df.sparkSession.createDataFrame(known, "gram bigint, template int, place int, label string, phrase boolean, grams int"))

    def post(batches):
        hashes = WordHashes()
        for batch in slices(batches):
            rows, counts, starts, grams = [], [], [], []
            for row, text in enumerate(texts(batch.column(2))):
                h = hashes.of(text.translate(ALNUM).split())
                rows.append(row)
                counts.append(len(h))
                starts.append(0)
                grams.append(np.zeros(1, np.int64))
                for k in (PHRASE_GRAM, TEXT_GRAM):
                    g = rolling(h, k).view(np.int64)
                    for at in range(0, len(g), PIECE):
                        rows.append(row)
                        counts.append(len(h))
                        starts.append(at)
                        grams.append(g[at : at + PIECE])
            take = pa.array(rows, pa.int64())
            ends = np.cumsum([0, *map(len, grams)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *grams])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(counts, pa.int64()), pa.array(starts, pa.int64()), lists],
                names=["doc_id", "text_key", "n_words", "start", "grams"],
            )

    slim = df.select(df[id_col].cast("bigint").alias("doc_id"), df[text_col].cast("string").alias("text")).select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    posted = arrow_map(slim, post, "doc_id bigint, text_key bigint, n_words bigint, start bigint, grams array<bigint>").withColumnRenamed("grams", "sent")
    matches = posted.select("doc_id", "text_key", "n_words", "start", F.posexplode("sent").alias("offset", "gram")).join(table, "gram")
    doc = ["doc_id", "text_key"]
    # Two rows of one document vote once; the number of rows is kept aside.
    votes = matches.withColumn("at", F.col("start") + F.col("offset")).groupBy(*doc, "n_words", "template", "place", "at", "label", "phrase", "grams").agg(F.count("*").alias("copies"))
    lines = votes.groupBy(*doc, "n_words", "template", "label", "phrase", "grams", (F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.count("*").alias("votes"), F.min("at").alias("first"), F.max("at").alias("last"), F.max("copies").alias("copies")
    )
    along = Window.partitionBy(*doc, "template").orderBy("diagonal")
    apart = F.col("phrase") | (F.col("template") < 0) | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > BAND, F.lit(True))
    merged = lines.withColumn("apart", apart.cast("int")).withColumn("band", F.sum("apart").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    merged = merged.groupBy(*doc, "n_words", "template", "label", "phrase", "grams", "band").agg(
        F.sum("votes").alias("votes"), F.min("first").alias("first"), (F.max("last") + TEXT_GRAM - 1).alias("last"), F.max("copies").alias("copies")
    )
    share = F.least(F.lit(1.0), F.col("votes") / F.col("grams"))
    is_place = F.col("phrase") & (F.col("votes") == F.col("grams"))
    is_span = ~F.col("phrase") & (F.col("template") >= 0) & (share >= SHARE) & (F.col("votes") >= DENSITY * (F.col("last") - F.col("first") + 1))
    out = merged.groupBy(*doc, "n_words").agg(
        F.max(F.when(F.col("template") < 0, F.col("copies"))).alias("copies"),
        F.sort_array(F.collect_list(F.when(is_place, F.struct(F.col("first").alias("word"), "label")))).alias("places"),
        F.sort_array(F.collect_list(F.when(is_span, F.struct("first", "last", "label", share.alias("share"))))).alias("spans"),
    )
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc_id", "n_words", "places", "spans")
