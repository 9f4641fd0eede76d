"""Licence scan: a trained paragraph classifier, in DataFrame and ML operations only.

Every line of a text is a paragraph. As notices are often broken into lines, the seam after a line is read as well: its last
`REACH` words and the `REACH` that follow in the next lines, up to a line without a word (a lone comment sign has none),
in blocks of lines with a word that licences use (HINT); lines are read whatever their words.
The words and word pairs of either are hashed into a sparse vector, and a multinomial logistic regression gives the probabilities of the licence families, of a licence that is none of them ("unknown"), and of no
licence at all. The raw scores are divided by a temperature that is fitted on examples held out from training, and a
family is believed only from `least` on. A family is reported once the line or seam also holds enough of one of its
templates' word pairs and, where families differ by it, the version, and nothing of a sister licence; a prediction that is not confirmed counts as unknown.

n_license counts the lines that name a family, and once for each block of lines a family that only its seams name.
n_unknown counts the unknown lines, but for those that are pieces of a notice named in their block (half of their pairs are
in one of its templates); in a block without named or unknown lines, unknown seams count as one.

Training examples are templates in varying carrier sentences (a fixed number), made-up licence names for "unknown", and
at most `negatives` paragraphs of the corpus for "none", of documents chosen by a hash. Templates are short notices as
projects print them and the ids of source files, no full licence texts.

A null or empty text has no paragraphs and no licence. Very long texts are read whole, repeated paragraphs count each. Rows that share a doc_id are reported together, once. Columns
beyond doc_id and text are ignored. A corpus without text is classified from the built-in examples alone.
"""

from __future__ import annotations

import itertools

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decidra.llm.common import plain_text, table

#: Notices by family.
TEMPLATES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0", "Apache License 2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http www apache org licenses LICENSE-2.0"],
    "mit": ["under the MIT License", "MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"],
    "bsd": ["under the BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "gpl-3.0": ["under the GNU General Public License, version 3", "GNU General Public License v3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "gpl-2.0": ["under the GNU General Public License, version 2", "GNU General Public License v2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License"],
    "lgpl": ["under the GNU Lesser General Public License", "GNU Lesser General Public License v3.0", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License", "under the terms of the GNU Library General Public License as published by the Free Software Foundation, either version 2 of the License"],
    "agpl-3.0": ["under the GNU Affero General Public License", "GNU Affero General Public License v3.0", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "mpl-2.0": ["under the Mozilla Public License, version 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "cc-by": ["under CC BY 4.0", "under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa": ["under CC BY-SA 4.0", "under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-nc": ["under CC BY-NC 4.0", "under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc0": ["CC0 1.0 Universal", "dedicated to the public domain under CC0"],
    "isc": ["under the ISC License", "Permission to use, copy, modify, and or distribute this software for any purpose with or without fee is hereby granted"],
    "zlib": ["under the zlib License", "This software is provided as is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software", "The origin of this software must not be misrepresented; you must not claim that you wrote the original software", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software"],
    "unlicense": ["under the Unlicense", "This is free and unencumbered software released into the public domain", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"],
    "all-rights-reserved": ["All rights reserved", "Copyright 2020 the authors. All rights reserved"],
}
# The ids of these families in source files.
SPDX = {
    "apache-2.0": ["Apache-2.0"], "mit": ["MIT"], "bsd": ["BSD-3-Clause", "BSD-2-Clause"], "gpl-3.0": ["GPL-3.0-only", "GPL-3.0-or-later"], "gpl-2.0": ["GPL-2.0-only", "GPL-2.0-or-later", "GPL-2.0"], "lgpl": ["LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later"],
    "agpl-3.0": ["AGPL-3.0-only", "AGPL-3.0-or-later"], "mpl-2.0": ["MPL-2.0"], "cc-by": ["CC-BY-4.0"], "cc-by-sa": ["CC-BY-SA-4.0"], "cc-by-nc": ["CC-BY-NC-4.0"], "cc0": ["CC0-1.0"], "isc": ["ISC"], "zlib": ["Zlib"], "unlicense": ["Unlicense"],
}
for _family, _ids in SPDX.items():
    TEMPLATES[_family] += [f"SPDX-License-Identifier: {i}" for i in _ids]
CARRIERS = ["{}.", "{}", "Licensed {}.", "Released {}.", "This work is licensed {}.", "This software is distributed {}, see the file LICENSE.", "The code of this project is available {}.", "See the notice below. {}. More follows in the text.", "Copyright the authors. {}."]
INVENTED = ["Zorbium", "Palladion", "Open Harvest", "Blue River", "Quintessa", "Northgate Community", "Tessel", "Verdant Data", "Old Mill", "Corpus Users"]
NONE_TEXTS = [
    "The river was high after the rain and the road to the village stayed closed.", "In the second part we look at the results and compare them by year.", "Call us on weekdays between nine and five.",
    "A list of names follows.", "Version 2 of the plan was better than version 3.", "He was free to use the general public library.", "Rights and duties were discussed under the old oak.", "Terms and conditions of the race: be on time.",
    "This program is free software: you can redistribute it and or modify", "This library is free software", "or at your option any later version",
]
FEATURES = 1 << 14
#: Words on each side of a seam: more than the longest template has (27).
REACH = 30
#: Words of which every template has one.
HINT = r"(?i)licen[sc]|copyright|reserved|creative|public|permi|redistribut|\bcc|apache|mozilla|terms|warrant|misrepresented|free to copy"
#: One of these pairs must stand in a text that is said to be of such a family,
VERSIONS = {
    "gpl-3.0": ["version 3", "license 3", "license v3", "gpl 3", "gpl v3"], "gpl-2.0": ["version 2", "license 2", "license v2", "gpl 2", "gpl v2"], "lgpl": ["lesser general", "library general", "identifier lgpl"], "agpl-3.0": ["affero general", "identifier agpl"],
    **{family: ["identifier " + i.split("-")[0].lower() for i in SPDX[family]] + pairs for family, pairs in {"mit": ["the mit", "mit license", "permission is", "is hereby", "free of", "of charge"], "isc": ["the isc", "isc license", "permission to", "without fee"]}.items()},
}
#: and none of these: sister licences and minor versions that share its words.
BARRED = {"gpl-3.0": ["lesser general", "library general", "affero general"], "gpl-2.0": ["lesser general", "library general", "affero general", "2 1"]}


def tokens(text: F.Column) -> F.Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def features(words: F.Column) -> F.Column:
    """The words and word pairs of these words."""
    return F.concat(words, F.transform(F.arrays_zip(words.alias("a"), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))).alias("b")), lambda p: F.concat_ws(" ", p["a"], p["b"])))


def word_pairs(words: F.Column) -> F.Column:
    return F.array_distinct(F.filter(words, lambda w: w.contains(" ")))


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph, at (its place) for every line with a word; a text without any has one row without paragraph."""
    return docs.select("doc_id", F.posexplode_outer(F.filter(F.split(plain_text(), "\n"), lambda p: F.trim(p) != "")).alias("at", "paragraph"))


def lines_and_seams(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines (on one row of a text), block, seam, tokens: every line with a word, and the seams after them. A text
    without any has one row without tokens."""
    text = plain_text()
    blocks = F.filter(F.split(F.concat(F.lit("\n"), text, F.lit("\n")), r"\n[^\p{L}\p{N}]*\n"), lambda b: b.rlike(r"[\p{L}\p{N}]"))
    n_lines = F.size(F.filter(F.split(text, "\n"), lambda p: F.trim(p) != ""))
    each = docs.select("doc_id", n_lines.alias("n_lines"), F.xxhash64(text).alias("row"), F.posexplode_outer(blocks).alias("at", "own"))
    each = each.select("doc_id", F.when(F.coalesce("at", F.lit(0)) == 0, F.col("n_lines")).alias("n_lines"), F.xxhash64("row", "at").alias("block"), F.coalesce(F.col("own").rlike(HINT), F.lit(False)).alias("hinted"), F.filter(F.transform(F.split("own", "\n"), tokens), lambda w: F.size(w) > 0).alias("lines"))
    # no word follows where no seam is read
    each = each.withColumn("heads", F.when(F.col("hinted"), F.transform("lines", lambda w: F.slice(w, 1, REACH))).otherwise(F.array().cast("array<array<string>>")))
    # at most REACH lines hold the REACH words that follow
    after = lambda i: F.when(F.col("hinted"), F.slice(F.flatten(F.slice("heads", i + 2, REACH)), 1, REACH)).otherwise(F.array().cast("array<string>"))
    each = each.select("doc_id", "n_lines", "block", F.posexplode_outer(F.transform("lines", lambda w, i: F.struct(w.alias("words"), after(i).alias("after")))).alias("i", "line"))
    each = each.select("doc_id", F.when(F.coalesce("i", F.lit(0)) == 0, F.col("n_lines")).alias("n_lines"), "block", F.col("line.words").alias("words"), F.col("line.after").alias("after"))
    last = F.slice("words", F.greatest(F.size("words") - REACH + 1, F.lit(1)), REACH)
    both = F.when(F.size("after") > 0, F.array("words", F.concat(last, "after"))).otherwise(F.array("words"))
    each = each.select("doc_id", "n_lines", "block", F.posexplode(both).alias("seam", "tokens"))
    return each.select("doc_id", F.when(F.col("seam") == 0, F.col("n_lines")).alias("n_lines"), "block", (F.col("seam") > 0).alias("seam"), "tokens")


def examples(spark: SparkSession, docs: DataFrame, negatives: int, seed: int) -> DataFrame:
    """family, text, held: the labelled paragraphs; a fifth is held out for calibration."""
    rows = [(family, c.format(t)) for family, ts in TEMPLATES.items() for t in ts for c in CARRIERS]
    rows += [("unknown", c.format(f"under the {name} {kind}")) for (name, kind), c in itertools.product(itertools.product(INVENTED, ["License", "Public License, version 1.0", "Terms of Use"]), CARRIERS[2:7])]
    rows += [("none", t) for t in NONE_TEXTS]
    known = spark.createDataFrame(rows, "family string, text string")
    # the ids alone go to the driver: `negatives` of them
    ids = [r[0] for r in docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(negatives).collect()]
    if ids:
        own = paragraphs(docs.filter(F.col("doc_id").isin(ids))).filter("paragraph is not null")
        hint = r"(?i)licen[sc]|copyright|rights reserved|creative commons|public domain|permission|redistribut|cc[ -]by|cc0"
        own = own.filter(~F.col("paragraph").rlike(hint)).orderBy(F.xxhash64(F.lit(seed), "doc_id", "at"), "doc_id", "at").limit(negatives)
        known = known.union(own.select(F.lit("none"), "paragraph"))
    return known.withColumn("held", F.pmod(F.xxhash64("text"), F.lit(5)) == 0)


class LicenseModel:
    """A fitted classifier: words of a paragraph -> family, with `probability`."""

    def __init__(self, regression, families: list[str], temperature: float):
        self.regression, self.families, self.temperature = regression, families, temperature

    def predict(self, df: DataFrame, words: str = "tokens") -> DataFrame:
        """Adds words (with their pairs), family and probability."""
        hashed = HashingTF(inputCol="words", outputCol="_vector", numFeatures=FEATURES, binary=True).transform(df.withColumn("words", features(F.coalesce(words, F.array().cast("array<string>")))))
        scored = self.regression.transform(hashed).withColumn("_score", vector_to_array("_raw")).drop("_raw", "_probability", "_prediction", "_vector")
        top = F.array_max("_score")
        total = F.aggregate("_score", F.lit(0.0), lambda s, x: s + F.exp((x - top) / self.temperature))
        names = F.array(*map(F.lit, self.families))
        return scored.withColumns({"family": names[F.array_position("_score", top).cast("int") - 1], "probability": 1 / total}).drop("_score")


def fit(spark: SparkSession, docs: DataFrame, negatives: int = 1000, seed: int = 5) -> LicenseModel:
    """Trains on the examples and fits the temperature on those held out."""
    families = [*TEMPLATES, "unknown", "none"]
    rows = examples(spark, docs, negatives, seed).collect()  # some hundred short paragraphs
    data = spark.createDataFrame([(float(families.index(r["family"])), r["text"], r["held"]) for r in rows], "label double, paragraph string, held boolean").coalesce(1)
    hashed = HashingTF(inputCol="words", outputCol="_vector", numFeatures=FEATURES, binary=True).transform(data.withColumn("words", features(tokens(F.col("paragraph")))))
    regression = LogisticRegression(featuresCol="_vector", labelCol="label", rawPredictionCol="_raw", probabilityCol="_probability", predictionCol="_prediction", family="multinomial", maxIter=30, regParam=2e-4, standardization=False)
    known = hashed.filter(~F.col("held")).cache()
    model = regression.fit(known)
    known.unpersist()
    held = [(r["label"], r["s"]) for r in model.transform(hashed.filter("held")).select("label", vector_to_array("_raw").alias("s")).collect()]
    return LicenseModel(model, families, _temperature(held))


def _temperature(held: list[tuple[float, list[float]]]) -> float:
    """The temperature with the least log loss."""
    import math

    def loss(t: float) -> float:
        out = 0.0
        for label, s in held:
            top = max(s)
            out += math.log(sum(math.exp((x - top) / t) for x in s)) - (s[int(label)] - top) / t
        return out

    return min((0.25 * 1.25**k for k in range(16)), key=loss) if held else 1.0


def scan(docs: DataFrame, model: LicenseModel | None = None, least: float = 0.6, confirm: float = 0.7) -> DataFrame:
    """doc_id, n_paragraphs, n_license, n_unknown, licenses (confirmed families), probability (of the surest)."""
    model = model or fit(docs.sparkSession, docs)
    found = model.predict(lines_and_seams(docs))
    pairs = lambda text: sorted({f"{a} {b}" for a, b in itertools.pairwise(w for w in _split(text))})
    templates = F.create_map(*(x for family, ts in TEMPLATES.items() for x in (F.lit(family), F.array(*(F.array(*map(F.lit, pairs(t))) for t in ts)))))
    own = word_pairs(F.col("words"))
    held = F.array_max(F.transform(F.element_at(templates, F.col("family")), lambda t: F.size(F.array_intersect(own, t)) / F.size(t)))
    versions = F.create_map(*(x for family, told in VERSIONS.items() for x in (F.lit(family), F.array(*map(F.lit, told)))))
    barred = F.create_map(*(x for family, no in BARRED.items() for x in (F.lit(family), F.array(*map(F.lit, no)))))
    told = F.coalesce(F.arrays_overlap(own, F.try_element_at(versions, F.col("family"))), F.lit(True)) & ~F.coalesce(F.arrays_overlap(own, F.try_element_at(barred, F.col("family"))), F.lit(False))
    is_license = F.col("tokens").isNotNull() & (F.col("family") != "none")
    sure = is_license & (F.col("family") != "unknown") & (F.col("probability") >= least)
    # the comparison runs for sure predictions alone
    verdict = F.when(sure & F.when(sure, (held >= confirm) & told), F.col("family")).when(is_license, F.lit("unknown"))
    judged = found.withColumn("verdict", verdict)
    named = F.col("verdict").isNotNull() & (F.col("verdict") != "unknown")
    unknown, seam = F.col("verdict") == "unknown", F.col("seam")
    # families that an unknown line can be a piece of, as keys with its block
    piece = lambda ts: F.exists(ts, lambda t: F.size(F.array_intersect(own, t)) * 2 >= F.size(own))
    pieces = F.transform(F.filter(F.map_entries(templates), lambda e: (F.size(own) > 0) & piece(e["value"])), lambda e: F.xxhash64("block", e["key"]))
    judged = judged.withColumns({"key": F.when(named, F.xxhash64("block", "verdict")), "pieces": F.when(unknown & ~seam, pieces)})
    found = judged.groupBy("doc_id").agg(
        F.coalesce(F.sum("n_lines"), F.lit(0)).alias("n_paragraphs"), F.count_if(named & ~seam).alias("named"),
        F.collect_set(F.when(~seam, F.col("key"))).alias("by_line"), F.collect_set(F.when(seam, F.col("key"))).alias("by_seam"), F.collect_list("pieces").alias("pieces"),
        F.collect_set(F.when(F.col("verdict").isNotNull() & (named | ~seam), F.col("block"))).alias("settled"), F.collect_set(F.when(unknown & seam, F.col("block"))).alias("unsettled"),
        F.array_join(F.array_sort(F.collect_set(F.when(named, F.col("verdict")))), ",").alias("licenses"),
        F.round(F.max(F.when(named, F.col("probability"))), 6).alias("probability"),
    )
    alone = F.size(F.filter("pieces", lambda p: ~F.arrays_overlap(p, F.array_union("by_line", "by_seam"))))
    return found.select(
        "doc_id", "n_paragraphs", (F.col("named") + F.size(F.array_except("by_seam", "by_line"))).alias("n_license"),
        (alone + F.size(F.array_except("unsettled", "settled"))).cast("long").alias("n_unknown"), "licenses", "probability",
    )


def _split(text: str) -> list[str]:
    import re

    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
