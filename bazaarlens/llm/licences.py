"""Licence scans: a trained paragraph classifier in DataFrame functions only.

Paragraphs (lines) become sets of word bigrams and trigrams. A multinomial logistic regression,
trained here on stretches of the notices below, on texts that are no notice of these families
(other licences, other versions, disclaimers, prose about licences) and on paragraphs of the corpus
that use no licence wording, gives the odds of each licence family and of ``unknown``. Only n-grams
of the notices have weights, so scoring is a join with a small weight table; a paragraph without any
such n-gram is unknown and produces no row. The temperature that calibrates the probabilities is
fitted with a first regression, on notices and texts that this one has not seen in any part: whole
texts are held out, not stretches of them. A second regression on all of them is the model.

A paragraph of up to two notice lengths is scored whole, a longer one by windows of that size that
overlap by a notice length. Each run of words whose bigrams all have weights is scored by itself
besides, so that two notices in one line are told apart. A prediction is confirmed when enough of
the paragraph's or window's n-grams occur in one notice of the predicted family, or when it holds
enough of the n-grams of such a notice, whatever else the line says; a run of ``RUN_WORDS`` words is
confirmed like a paragraph, a shorter one only by what it holds of a notice. Titles and identifiers
confirm only a line that says nothing else. A line that names versions, none of them the family's,
confirms nothing.

Bounds (parameters): ``MAX_GRAMS`` n-grams in the weight table, about ``BACKGROUND`` windows of
corpus lines to learn the unknown class from. Scoring reads every paragraph of every text. A run of
licence words is one window however long its line is: a line of millions of such words costs one
group of at most ``MAX_GRAMS`` distinct n-grams.

Null and empty texts have no paragraphs. Repeated rows give repeated rows; other columns are
ignored. Without background paragraphs the fixed sentences below stand for the unknown class.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bazaarlens.llm.common import staged

UNKNOWN = "unknown"
MAX_GRAMS = 8_192
BACKGROUND = 2_000
MAX_ITERATIONS = 40
MIN_PROBABILITY = 0.2
MIN_SHARED = 0.6
RUN_WORDS = 12
TITLE_WORDS = 12
BACKGROUND_WORDS = 40
LINE_CHARS = 120
WHOLE = 5

# Standard notices and passages of public licences, by family.
NOTICES = [
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license, see the LICENSE file"
            " for details."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this"
            " software and associated documentation files, to deal in the software without"
            " restriction, including without limitation the rights to use, copy, modify, merge,"
            " publish, distribute, sublicense, and/or sell copies of the software"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use"
                   " this file except in compliance with the License. You may obtain a copy of the"
                   " License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software"
                   " distributed under the License is distributed on an AS IS BASIS, WITHOUT"
                   " WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under"
                " the terms of the GNU General Public License as published by the Free Software"
                " Foundation, either version 3 of the License, or (at your option) any later"
                " version."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under"
                " the terms of the GNU General Public License version 2 as published by the Free"
                " Software Foundation."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the"
             " terms of the GNU Lesser General Public License as published by the Free Software"
             " Foundation"),
    ("lgpl", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("agpl-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("bsd", "Released under the BSD 3-Clause License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are"
            " permitted provided that the following conditions are met: Redistributions of source"
            " code must retain the above copyright notice, this list of conditions and the"
            " following disclaimer."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License,"
                " v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain"
                " one at http://mozilla.org/MPL/2.0/."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with"
            " or without fee is hereby granted, provided that the above copyright notice and this"
            " permission notice appear in all copies."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International"
              " License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0"
                 " International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0"
                 " International License."),
    ("public-domain", "This is free and unencumbered software released into the public domain."),
    ("public-domain", "To the extent possible under law, the author has waived all copyright and"
                      " related rights to this work under CC0 1.0."),
]
# Titles and identifiers, by family; they count only where a line says nothing else.
TITLES = [
    ("mit", "MIT License"), ("mit", "The MIT License (MIT)"), ("mit", "SPDX-License-Identifier: MIT"),
    ("apache-2.0", "Apache License Version 2.0"), ("apache-2.0", "Apache License 2.0"),
    ("apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("gpl-3.0", "GNU General Public License v3.0 or later"), ("gpl-3.0", "GNU General Public License version 3"),
    ("gpl-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"), ("gpl-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("gpl-2.0", "GNU General Public License v2.0 only"), ("gpl-2.0", "GNU General Public License version 2"),
    ("gpl-2.0", "SPDX-License-Identifier: GPL-2.0-only"), ("gpl-2.0", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("lgpl", "GNU Lesser General Public License v2.1"), ("lgpl", "GNU Lesser General Public License version 3"),
    ("lgpl", "SPDX-License-Identifier: LGPL-2.1-or-later"), ("lgpl", "SPDX-License-Identifier: LGPL-3.0-only"),
    ("agpl-3.0", "GNU Affero General Public License v3.0"),
    ("agpl-3.0", "SPDX-License-Identifier: AGPL-3.0-or-later"), ("agpl-3.0", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("bsd", "BSD 3-Clause License"), ("bsd", "BSD 2-Clause License"), ("bsd", "The 3-Clause BSD License"),
    ("bsd", "SPDX-License-Identifier: BSD-3-Clause"), ("bsd", "SPDX-License-Identifier: BSD-2-Clause"),
    ("mpl-2.0", "Mozilla Public License Version 2.0"), ("mpl-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("isc", "ISC License"), ("isc", "SPDX-License-Identifier: ISC"),
    ("cc-by", "Creative Commons Attribution 4.0 International"), ("cc-by", "SPDX-License-Identifier: CC-BY-4.0"),
    ("cc-by-sa", "Creative Commons Attribution-ShareAlike 4.0 International"),
    ("cc-by-sa", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    ("cc-by-nc", "Creative Commons Attribution-NonCommercial 4.0 International"),
    ("cc-by-nc", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    ("public-domain", "The Unlicense"), ("public-domain", "CC0 1.0 Universal"),
    ("public-domain", "SPDX-License-Identifier: CC0-1.0"), ("public-domain", "SPDX-License-Identifier: Unlicense"),
]
# The versions a family's notices may name; other families name none.
VERSIONS = {
    "apache-2.0": ["2", "2.0"], "gpl-3.0": ["3", "3.0"], "gpl-2.0": ["2", "2.0"],
    "lgpl": ["2", "2.0", "2.1", "3", "3.0"], "agpl-3.0": ["3", "3.0"], "mpl-2.0": ["2", "2.0"],
}
_VERSION = r"\b(?:version|v\.?)\s*(\d+(?:\.\d+)?)"
# Texts with licence wording that are no notice of these families.
OTHERS = [
    "The driver had to renew the licence before the end of the year.",
    "A permission to build on this land was granted by the city.",
    "The software is distributed in many countries and used by many people.",
    "All rights reserved.",
    "Copyright law is a part of the course.",
    "Please read the terms of service and the privacy policy of this site.",
    "The general public was free to use the library.",
    "The version 2.0 of the program was released in the spring.",
    "See the file for details and follow the instructions of the manual.",
    "The foundation published a list of conditions for the award.",
    # other licences
    "Licensed under the Eclipse Public License, version 2.0.",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public"
    " License v2.0 which is available at the address below.",
    "Licensed under the European Union Public Licence, version 1.2.",
    "Licensed under the Common Development and Distribution License, version 1.0.",
    "Distributed under the Boost Software License, Version 1.0.",
    "This work is licensed under the Artistic License 2.0.",
    "Released under the zlib License.",
    "Released under the Microsoft Public License.",
    "Released under the Server Side Public License, version 1.",
    "Licensed under the Open Software License version 3.0.",
    "SPDX-License-Identifier: EPL-2.0", "SPDX-License-Identifier: Zlib", "SPDX-License-Identifier: BSL-1.0",
    "SPDX-License-Identifier: LicenseRef-Proprietary", "Licensed under CC BY-ND 4.0.",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    # versions that the families do not have
    "This work is licensed under the GNU General Public License, version 4.",
    "This work is licensed under the GNU General Public License, version 1.",
    "Licensed under the Apache License, Version 1.1.", "Licensed under the Mozilla Public License, version 1.1.",
    # disclaimers, which many licences share
    "The software is provided as is, without warranty of any kind, express or implied, including but not"
    " limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
    "In no event shall the authors or copyright holders be liable for any claim, damages or other liability,"
    " whether in an action of contract, tort or otherwise, arising from, out of or in connection with the"
    " software or the use or other dealings in the software.",
    "This program is distributed in the hope that it will be useful, but without any warranty; without even"
    " the implied warranty of merchantability or fitness for a particular purpose.",
    # prose about licences
    "We compared the MIT License with the Apache License and found few differences in practice.",
    "The company changed the license of its database last year and many users were unhappy.",
    "Under the GNU General Public License, derived works must be distributed with their source code.",
    "The lawyer explained what a Creative Commons license means for photographers.",
    "BSD licenses are popular with vendors of network hardware.",
    "Most packages in the archive have a license of the MIT or of the BSD family.",
    "You may not use this file except for the purposes of the exercise.",
    "Permission is hereby granted by the council to use the hall free of charge.",
]
_CUES = r"(?i)licen[sc]|copyright|permission|warrant|redistribut|domain|creative|gnu |apache|\bcc\b"


def words(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def grams(own: Column) -> Column:
    """Bigrams and trigrams of a word array."""
    def runs(n: int) -> Column:
        places = F.sequence(F.lit(1), F.size(own) - (n - 1))
        joined = F.transform(places, lambda i: F.array_join(F.slice(own, i, n), " "))
        return F.when(F.size(own) >= n, joined).otherwise(F.array().cast("array<string>"))

    return F.concat(runs(2), runs(3))


# --------------------------------------------------------------------- training

def _stretches(rows: DataFrame) -> DataFrame:
    """``family, fold, words, weight``: each text, and its stretches of 5, 8, 12 and 20 words; the
    fold is that of the whole text, which counts ``WHOLE`` times."""
    own = rows.withColumn("_w", words(F.col("text")))
    length = F.explode(F.array(*[F.lit(n) for n in (5, 8, 12, 20, 1_000)]))
    cut = own.withColumn("_n", length).withColumn(
        "_from", F.explode(F.sequence(F.lit(1), F.greatest(F.size("_w") - F.col("_n") + 1, F.lit(1))))
    )
    weight = F.when(F.size("_w") <= F.col("_n"), float(WHOLE)).otherwise(1.0)
    return cut.select(
        "family", "fold", F.slice("_w", F.col("_from"), F.col("_n")).alias("words"), weight.alias("weight")
    ).distinct()


def _background(docs: DataFrame, id_col: str, text_col: str, limit: int) -> DataFrame:
    """About ``limit`` windows of corpus lines without licence wording. A hash of the line chooses
    among all lines, so repeated lines count once and only chosen ones are cut into words."""
    size = docs.agg(F.sum(F.char_length(text_col))).first()[0] or 0
    # a share of lines that leaves about twice as many windows as wanted
    share = min(1 << 30, -(-2 * limit * LINE_CHARS * (1 << 30) // max(size, 1)))
    lines = docs.select(F.explode(F.split(F.col(text_col), "\n")).alias("line"))
    chosen = lines.where(F.pmod(F.xxhash64("line"), F.lit(1 << 30)) < share)
    own = chosen.where(~F.col("line").rlike(_CUES)).select(words(F.col("line")).alias("_w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("_w"), F.lit(1)), F.lit(BACKGROUND_WORDS))
    windows = own.where(F.size("_w") > 2).select(
        F.explode(F.transform(starts, lambda i: F.slice("_w", i, BACKGROUND_WORDS))).alias("words")
    ).where(F.size("words") > 2)
    kept = windows.groupBy(F.xxhash64("words").alias("_h")).agg(F.first("words").alias("words"))
    return kept.orderBy("_h").limit(limit).select(
        F.lit(UNKNOWN).alias("family"), F.pmod("_h", F.lit(5)).cast("int").alias("fold"), "words",
        F.lit(1.0).alias("weight"),
    )


def train(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", background: int = BACKGROUND,
    max_grams: int = MAX_GRAMS,
) -> tuple[list[str], DataFrame, list[float], float]:
    """(families, table ``gram, weights, notices``, intercepts, temperature)."""
    spark = docs.sparkSession
    families = sorted({family for family, _ in NOTICES}) + [UNKNOWN]
    number = F.array_position(F.array(*map(F.lit, families)), F.col("family")) - 1
    fixed = _rows(spark, _folds())
    examples = (
        _stretches(fixed).unionByName(_background(docs, id_col, text_col, background))
        .select(number.cast("double").alias("label"), grams(F.col("words")).alias("grams"), "fold", "weight")
    )
    examples = staged(examples.coalesce(4), "licence-examples")
    # the vocabulary is that of the notices; whatever else the corpus says has no weight
    known = examples.where(F.col("label") < len(families) - 1)
    counter = CountVectorizer(
        inputCol="grams", outputCol="features", vocabSize=max_grams, binary=True
    ).fit(known)
    vectors = counter.transform(examples).coalesce(4).persist()
    regression = LogisticRegression(family="multinomial", regParam=0.001, maxIter=MAX_ITERATIONS, weightCol="weight")
    apart = regression.fit(vectors.where("fold <> 0"))
    temperature = _temperature(apart.transform(vectors.where("fold = 0")), len(families))
    model = regression.fit(vectors)
    vectors.unpersist()
    matrix = model.coefficientMatrix.toArray()
    weights = spark.createDataFrame(
        [(gram, [float(v) for v in matrix[:, i]]) for i, gram in enumerate(counter.vocabulary)],
        "gram string, weights array<double>",
    )
    owners = (
        _rows(spark, [(str(i), text, 0) for i, (_, text) in enumerate([*NOTICES, *TITLES])])
        .select(F.col("family").cast("int").alias("notice"),
                F.explode(grams(words(F.col("text")))).alias("gram"))
        .groupBy("gram").agg(F.collect_set("notice").alias("notices"))
    )
    none = F.array().cast("array<int>")
    table = weights.join(owners, "gram", "left").withColumn(
        "notices", F.coalesce("notices", none)
    )
    # frozen: scoring reads the table, it never trains again
    table = staged(table.coalesce(1), "licence-weights")
    return families, table, [float(v) for v in model.interceptVector], temperature


def _folds() -> list[tuple[str, str, int]]:
    """(family, text, fold) of notices, titles and other texts. Of every family some whole texts
    are in fold 0, and some are not; of the others every fifth."""
    out, seen = [], {}
    for family, text in [*NOTICES, *TITLES]:
        seen[family] = nth = seen.get(family, -1) + 1
        out.append((family, text, 0 if nth % 3 == 1 else 1))
    return out + [(UNKNOWN, text, int(i % 5 > 0)) for i, text in enumerate(OTHERS)]


def _rows(spark: SparkSession, rows: list[tuple[str, str, int]]) -> DataFrame:
    return spark.createDataFrame(rows, "family string, text string, fold int")


def _temperature(predicted: DataFrame, classes: int) -> float:
    """The temperature with the least log loss on ``predicted``, on a fixed grid."""
    raw = vector_to_array("rawPrediction")
    own = F.element_at(raw, (F.col("label") + 1).cast("int"))
    tries = [0.5, 0.7, 0.85, 1.0, 1.2, 1.5, 2.0, 2.5, 3.0, 4.0]
    losses = [
        F.avg(F.log(_exp_sum(raw, F.array_max(raw), t)) - (own - F.array_max(raw)) / t)
        for t in tries
    ]
    values = predicted.agg(*losses).first()
    kept = [(loss, t) for loss, t in zip(values, tries, strict=True) if loss is not None]
    return min(kept)[1] if kept else 1.0


def _exp_sum(logits: Column, top: Column, temperature: float) -> Column:
    return F.aggregate(
        logits, F.lit(0.0), lambda s, v: s + F.exp((v - top) / F.lit(temperature))
    )


# ---------------------------------------------------------------------- scoring

def _sizes() -> tuple[list[int], int]:
    """Distinct n-grams of each notice and title, and the words of the longest."""
    own = [re.findall(r"[^\W_]+", text.lower()) for _, text in [*NOTICES, *TITLES]]
    sizes = [len({tuple(w[i : i + n]) for n in (2, 3) for i in range(len(w) - n + 1)}) for w in own]
    return sizes, max(map(len, own))


def _grams_in(n_words: Column) -> Column:
    return F.greatest(n_words - 1, F.lit(0)) + F.greatest(n_words - 2, F.lit(0))


def _in_units(found: DataFrame, keys: list[str], step: int) -> DataFrame:
    """``keys, _run, _unit, _total, gram``: the n-grams of each window and run, with all that it has."""
    line = Window.partitionBy(*keys).orderBy("_at")
    fresh = F.col("_at") - F.lag("_at", 1, -2).over(line) > 1
    runs = found.withColumn("_fresh", fresh.cast("int")).withColumn(
        "_start", F.max(F.when(F.col("_fresh") == 1, F.col("_at"))).over(line)
    )
    own = Window.partitionBy(*keys, "_start")
    runs = runs.withColumn("_stop", F.max("_at").over(own) + 2)
    # the last window holds the end of the line; a line of up to two steps has one
    last = F.greatest(F.ceil(F.col("_words") / step).cast("int") - 2, F.lit(0))
    at = F.floor(F.col("_at") / step).cast("int")
    first = F.least(F.greatest(at - 1, F.lit(0)), last)
    windows = F.transform(
        F.sequence(first, F.least(at, last)),
        lambda k: F.struct(
            F.lit(False).alias("_run"), k.alias("_unit"),
            _grams_in(F.least(F.col("_words") - k * step, F.lit(2 * step))).alias("_total"),
        ),
    )
    run = F.struct(
        F.lit(True).alias("_run"), F.col("_start").alias("_unit"),
        _grams_in(F.col("_stop") - F.col("_start")).alias("_total"),
    )
    return runs.select(*keys, "gram", F.inline(F.concat(windows, F.array(run)))).distinct()


def paragraphs(
    docs: DataFrame, model: tuple, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Licence paragraphs, one row per line and family:
    ``_id, _text_hash, line, family, probability, shared, confirmed``."""
    families, table, intercepts, temperature = model
    rows = docs.select(
        F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_text_hash"),
        F.posexplode(F.split(F.col(text_col), "\n")).alias("line", "_line"),
    ).select(
        "_id", "_text_hash", "line", words(F.col("_line")).alias("_w"),
        F.regexp_extract_all(F.lower("_line"), F.lit(_VERSION), F.lit(1)).alias("_versions"),
    )
    after = F.greatest(F.size("_w"), F.lit(1))
    near = F.arrays_zip(
        F.col("_w").alias("a"), F.slice("_w", 2, after).alias("b"),
        F.slice("_w", 3, after).alias("c"),
    )
    keys = ["_id", "_text_hash", "line"]
    places = rows.where(F.size("_w") > 1).select(
        *keys, "_versions", F.size("_w").alias("_words"), F.posexplode(near).alias("_at", "_p")
    )
    two = F.concat("_p.a", F.lit(" "), "_p.b")
    three = F.concat("_p.a", F.lit(" "), "_p.b", F.lit(" "), "_p.c")
    found = (
        places.select(*keys, "_versions", "_words", "_at", F.explode(F.array(two, three)).alias("gram"))
        .where("gram IS NOT NULL")
        # at most MAX_GRAMS rows of bounded width
        .join(F.broadcast(table.select("gram")), "gram")
        .distinct()  # repeated rows count once
    )
    sizes, longest = _sizes()
    # a gram counts once in a window or run
    units = _in_units(found, [*keys, "_versions", "_words"], longest)
    parts = units.join(F.broadcast(table), "gram")
    sums = [F.sum(F.element_at("weights", i + 1)).alias(f"_k{i}") for i in range(len(families))]
    hits = [
        F.sum(F.array_contains("notices", i).cast("int")).alias(f"_n{i}")
        for i in range(len(NOTICES) + len(TITLES))
    ]
    scored = parts.groupBy(*keys, "_versions", "_words", "_run", "_unit", "_total").agg(*sums, *hits)
    logits = F.array(*[F.col(f"_k{i}") + F.lit(b) for i, b in enumerate(intercepts)])
    best = F.array_position("_logits", F.col("_top")).cast("int")
    family = F.element_at(F.array(*map(F.lit, families)), best)

    def most(hit: list[Column], of: list[tuple[str, str]]) -> Column:
        """The greatest of ``hit`` (by notice) over the notices of the family."""
        return F.greatest(F.lit(0.0), F.lit(0.0), *[
            F.when(F.col("family") == own, hit[i]).otherwise(0.0) for i, (own, _) in enumerate(of)
        ])

    n = len(NOTICES)
    of_line = most([F.col(f"_n{i}") / F.col("_total") for i in range(n)], NOTICES)
    of_notice = most([F.col(f"_n{i}") / F.lit(sizes[i]) for i in range(n)], NOTICES)
    short = F.col("_run") & (F.col("_total") < 2 * RUN_WORDS - 3)
    # a title counts by what the line and it share of all that either has
    both = [F.col(f"_n{n + i}") / (F.col("_total") + F.lit(sizes[n + i]) - F.col(f"_n{n + i}"))
            for i in range(len(TITLES))]
    alone = ~F.col("_run") & (F.col("_words") <= TITLE_WORDS)
    of_title = F.when(alone, most(both, TITLES)).otherwise(0.0)
    shared = F.greatest(of_title, F.when(short, of_notice).otherwise(F.greatest(of_line, of_notice)))
    allowed = F.create_map(*[F.lit(x) for f, v in VERSIONS.items() for x in (f, ",".join(v))])
    held = F.split(F.try_element_at(allowed, F.col("family")), ",")
    wrong = held.isNotNull() & (F.size("_versions") > 0) & ~F.arrays_overlap(F.col("_versions"), held)
    sure = (F.col("shared") >= MIN_SHARED) & ~F.coalesce(wrong, F.lit(False))
    return (
        scored.withColumn("_logits", logits).withColumn("_top", F.array_max("_logits"))
        .withColumn("family", family)
        .withColumn("probability", 1 / _exp_sum(F.col("_logits"), F.col("_top"), temperature))
        .withColumn("shared", shared)
        .where((F.col("family") != UNKNOWN) & (F.col("probability") >= MIN_PROBABILITY))
        .where(~F.col("_run") | sure)
        .groupBy(*keys, "family").agg(
            F.coalesce(F.max(F.when(sure, F.col("probability"))), F.max("probability"))
            .alias("probability"),
            F.max("shared").alias("shared"), F.max(sure).alias("confirmed"),
        )
    )


def scan(
    docs: DataFrame, model: tuple, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per document ``id_col, n_predicted, n_confirmed, families, probability``: licence
    paragraphs (a line of several families is one of each), those confirmed by a notice, the confirmed families in order, comma-joined, and
    the highest probability among the confirmed (null without one)."""
    sure = F.col("confirmed")
    found = paragraphs(docs, model, id_col, text_col).groupBy("_id", "_text_hash").agg(
        F.count("*").alias("n_predicted"), F.count_if(sure).alias("n_confirmed"),
        F.array_join(F.array_sort(F.collect_set(F.when(sure, F.col("family")))), ",").alias("families"),
        F.max(F.when(sure, F.col("probability"))).alias("probability"),
    )
    rows = docs.select(F.col(id_col).alias("_own"), F.xxhash64(text_col).alias("_own_hash"))
    same = F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_own_hash") == F.col("_text_hash"))
    none = F.lit(0).cast("bigint")
    return rows.join(found, same, "left").select(
        F.col("_own").alias(id_col), F.coalesce("n_predicted", none).alias("n_predicted"),
        F.coalesce("n_confirmed", none).alias("n_confirmed"),
        F.coalesce("families", F.lit("")).alias("families"), "probability",
    )
