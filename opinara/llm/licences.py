"""Licence scans: parts of a text against licence notices by the Dice coefficient over word bigrams.

Lines, paragraphs and the whole text are normalised (ASCII letters lower-cased, anything but letters, digits and line
ends becomes a space) and compared as sets of word bigrams.  Dice >= t needs sizes a and b with
``t / (2 - t) <= a / b <= (2 - t) / t``, so a part is compared only with notices of a fitting size, and a part that
fits none is dropped before its bigrams are built.  A close part shares so many bigrams with a notice that it holds one of
any ``size - least overlap + 1`` of the notice's; a text without both words of such a bigram, for every notice, is
not normalised at all.  All work is built-in functions inside the row, without a shuffle of texts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.llm.frames import fresh, named

#: Notices as they are published (fixed texts).
NOTICES: dict[str, str] = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."),
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-licensed": "Licensed under the MIT License.",
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions:"),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
}
THRESHOLD = 0.8


def notice_bigrams(text: str) -> list[str]:
    words = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def size_bounds(size: int, threshold: float) -> tuple[int, int]:
    """Sizes whose Dice coefficient with a set of ``size`` can reach the threshold."""
    ratio = threshold / (2 - threshold)
    return math.ceil(size * ratio - 1e-9), math.floor(size / ratio + 1e-9)


def required_bigrams(sets: Mapping[str, list[str]], threshold: float) -> list[tuple[str, str]]:
    """Bigrams of which every part that is close to a notice holds at least one: a prefix of each notice's set.

    Any order of the set will do; bigrams of long words come first, as few texts hold them.
    """
    out = set()
    for bigrams in sets.values():
        size = len(bigrams)
        overlap = math.ceil(threshold * (size + size_bounds(size, threshold)[0]) / 2 - 1e-9)
        by_length = sorted((tuple(b.split(" ")) for b in bigrams), key=lambda b: (-min(map(len, b)), b))
        out.update(by_length[: size - max(overlap, 1) + 1])
    return sorted(out)


def may_match(text: Column, sets: Mapping[str, list[str]], threshold: float) -> Column:
    """Whether ``text`` holds, anywhere, both words of a required bigram."""
    def holds(low: Column) -> Column:
        return F.exists(F.array(low), lambda t: reduce(or_, (
            t.contains(a) & t.contains(b) for a, b in required_bigrams(sets, threshold))))

    # Other letters that fold to ASCII ones only let more texts through.
    return holds(F.lower(text))


def parts(text: Column) -> Column:
    """Distinct normalised lines, paragraphs and the whole text."""
    clean = F.regexp_replace(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
                             "[^a-z0-9\n]+", " ")

    def pieces(c: Column) -> Column:
        flat = F.transform(F.concat(F.split(c, "\n ?\n"), F.array(c)), lambda p: F.translate(p, "\n", " "))
        return F.concat(F.split(c, "\n"), flat)

    # The normalised text is bound as an element, so it is made once.
    return F.array_distinct(F.transform(F.flatten(F.transform(F.array(clean), pieces)), lambda p: F.trim(p)))


def matches(text: Column, notices: Mapping[str, str] = NOTICES, threshold: float = THRESHOLD) -> Column:
    """Array of (licence, dice, part): the closest notice of each part that is close to one; ties go to the first name."""
    sets = {name: notice_bigrams(notice) for name, notice in sorted(notices.items())}
    bounds = {name: size_bounds(len(s), threshold) for name, s in sets.items()}
    least, most = min(low for low, _ in bounds.values()), max(high for _, high in bounds.values())

    def bigrams(words: Column) -> Column:
        return F.array_distinct(F.zip_with(
            F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1),
            lambda a, b: F.concat_ws(" ", a, b)))

    def closest(p: Column) -> Column:
        n = F.size(p["bigrams"])
        scores = F.array(*(
            F.when(n.between(*bounds[name]), F.struct(
                (2 * F.size(F.array_intersect(p["bigrams"], F.lit(s))) / (n + len(s))).alias("dice"),
                F.lit(-place).alias("place"), F.lit(name).alias("licence")))
            for place, (name, s) in enumerate(sets.items())))
        return F.struct(F.array_max(scores).alias("best"), p["part"].alias("part"))

    # Each step is a pass of its own, so that nothing is evaluated once for each notice.
    long_enough = F.filter(parts(text), lambda p: F.length(F.regexp_replace(p, "[^ ]+", "")) >= least)
    # Where a line ended in a sign, two blanks meet.
    with_words = F.transform(long_enough, lambda p: F.struct(
        p.alias("part"), F.array_remove(F.split(p, " "), "").alias("words")))
    with_sets = F.transform(with_words, lambda p: F.struct(
        p["part"].alias("part"), F.when(F.size(p["words"]) > 1, bigrams(p["words"])).alias("bigrams")))
    fitting = F.filter(with_sets, lambda p: F.size(p["bigrams"]).between(least, most))
    close = F.filter(F.transform(fitting, closest), lambda p: p["best"]["dice"] >= threshold)
    found = F.transform(close, lambda p: F.struct(
        p["best"]["licence"].alias("licence"), p["best"]["dice"].alias("dice"), p["part"].alias("part")))
    none = F.lit([]).cast("array<struct<licence:string,dice:double,part:string>>")
    return F.when(may_match(text, sets, threshold), found).otherwise(none)


def scan(df: DataFrame, text: str = "text", notices: Mapping[str, str] = NOTICES,
         threshold: float = THRESHOLD) -> DataFrame:
    """All rows and columns of ``df`` plus ``licences``, see ``matches``.

    Null and empty texts have no matches; a part that occurs twice in a text counts once; equal rows get equal
    results; an empty table gives an empty one.  The column gets a suffix if ``df`` has one of that name.
    """
    return df.withColumn(fresh(df, "licences"), matches(named(df, text).cast("string"), notices, threshold))
