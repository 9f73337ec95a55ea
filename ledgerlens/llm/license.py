"""License scans: parts of texts against templates by Dice over word bigrams, in DataFrame functions.

A text is normalised (A-Z lowered, runs of anything but letters, digits and dots become one
space). The set of word bigrams of a part is compared with a template's:
2 |A and B| / (|A| + |B|). Parts are of two kinds:

* a line, against ``templates``;
* a window of words, wherever its lines end, against ``templates`` and ``whole`` (headers and
  whole licence texts). It begins where a run of the template's bigrams begins and has as many
  words as the template, or ends where a later run ends, up to the most that can reach the
  threshold. Only the end of the text makes it shorter, so "CC BY 3.0" is not cut to "CC BY".

A text gets every line that matches; then windows, those of most common bigrams first, that
overlap no window chosen before and no matched line of the same template or of as many common
bigrams. So a notice that stands on a line is not found again.

The threshold bounds how many of a template's bigrams a part may lack, so a text without
certain words of every template is dropped before it is normalised. The templates are held in
the plan as literals, so nothing is shuffled or broadcast.

Defined results: null and empty texts, and parts of fewer than two words, match nothing; a
line gets at most one template, the best (ties: the first in order); repeated rows give
repeated results; very long texts are scanned whole; other columns are ignored. ``part`` is
the number of the line, or of the line where a window begins; ``matched`` is the line, or the
normalised words of the window.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DICE = (4, 5)
BREAKS = r"\r\n|\r|\n"

#: license and the words of a notice of it (fixed values, in order)
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)

_GNU = "This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as published by the Free Software Foundation; either version {2} of the License, or (at your option) any later version."

#: license and a longer text of it (fixed values, numbered after the templates): headers that stand over several lines, and whole licences
WHOLE = (
    ("GPL-2.0", _GNU.format("program", "", "2")),
    ("GPL-3.0", _GNU.format("program", "", "3")),
    ("LGPL-2.1", _GNU.format("library", "Lesser ", "2.1")),
    ("LGPL-3.0", _GNU.format("library", "Lesser ", "3")),
    ("AGPL-3.0", _GNU.format("program", "Affero ", "3")),
    *((name, (Path(__file__).parent / "licenses" / f"{name}.txt").read_text()) for name in ("MIT", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "MPL-2.0")),
)


def normalise(text: str) -> list[str]:
    """The words of a template, as in ``words_of``."""
    lowered = text.translate(str.maketrans(UPPER, LOWER))
    return re.sub(r"[^\w.]+|_", " ", re.sub(r"\.+(?=\s|$)", " ", lowered)).split()


def bigrams(text: str) -> list[str]:
    words = normalise(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def anchors(words: str, num: int, den: int) -> list[str]:
    """Words of a template of which a part that reaches num/den has at least one.

    Such a part lacks at most a share of the template's bigrams; the words, long ones
    and numbers first, touch more bigrams than that.
    """
    grams = [tuple(g.split(" ")) for g in bigrams(words)]
    need = len(grams) - -(-num * len(grams) // (2 * den - num)) + 1
    found: list[str] = []
    left = set(grams)
    while len(grams) - len(left) < need:
        found.append(max(sorted({w for g in left for w in g}), key=lambda w: len(w) + 3 * any(c.isdigit() for c in w)))
        left = {g for g in left if found[-1] not in g}
    return found


def words_of(part: Column) -> Column:
    """Words of a part: dots count within words only."""
    bare = F.regexp_replace(F.translate(part, UPPER, LOWER), r"\.+(?=\s|$)", " ")
    return F.filter(F.split(F.regexp_replace(bare, r"[^\p{L}\p{N}.]+", " "), " "), lambda w: w != "")


def bounds(size: int, num: int, den: int) -> tuple[int, int]:
    """Least and most bigrams of a part that can reach num/den with a template of ``size``."""
    return -(-num * size // (2 * den - num)), size * (2 * den - num) // num


def weights(words: str, num: int, den: int) -> tuple[dict[str, int], int]:
    """Words of a template with bigrams that a part without the word lacks, each counted once, and the most that a part may lack."""
    left = [g.split(" ") for g in bigrams(words)]
    most, found = len(left) - bounds(len(left), num, den)[0], {}
    while 2 * sum(found.values()) < 3 * most:
        held: dict[str, int] = {}
        for g in left:
            for w in {w for w in g if len(w) > 4 and set(w) <= set(LOWER)}:
                held[w] = held.get(w, 0) + 1
        if not held:
            break
        word = max(sorted(held), key=held.__getitem__)
        rest = [g for g in left if word not in g]
        found[word], left = len(left) - len(rest), rest
    return found, most


def _let(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _pairs(words: Column) -> Column:
    return F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.concat_ws(" ", a, b))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, dice: tuple[int, int] = DICE, whole: tuple[tuple[str, str], ...] = WHOLE) -> DataFrame:
    """doc_id, part (line number from 0), license, template, common, dice and matched text."""
    num, den = dice
    known = [(name, grams, len(normalise(words)) - 1, bounds(len(grams), num, den)) for name, words in (*templates, *whole) for grams in [bigrams(words)]]
    def literal(grams: list[str]) -> Column:
        return F.split(F.lit("|".join(grams)), r"\|")  # one literal, however long

    # texts without any anchor of a template, or with too few words of the longer texts, are out
    sought = sorted({w for _, words in templates for w in anchors(words, num, den)})
    signs = [w for w in sought if not set(w) <= set(LOWER)]  # with digits or dots: found in the text as they are
    shares = [weights(words, num, den) for _, words in whole]
    watched = literal(sorted({w for share, _ in shares for w in share} | set(sought)))

    def gained(there: Column, share: dict[str, int]) -> Column:
        worth = F.str_to_map(F.lit(",".join(f"{w}:{n}" for w, n in share.items())))  # one literal
        return F.aggregate(there, F.lit(0), lambda n, w: n + F.coalesce(F.try_element_at(worth, w).cast("int"), F.lit(0)))

    def hopeful(low: Column) -> Column:
        """Whether a lowered text may match: it is cut into words once, not searched for each."""

        def judged(there: Column) -> Column:
            out = F.arrays_overlap(there, literal(sought))
            for (share, most), (_, _, _, (least, _)) in zip(shares, known[len(templates) :]):
                # as many bigrams have one word more, each of a byte and a space at least
                out = out | ((F.length(low) >= 2 * least) & (gained(there, share) >= sum(share.values()) - most))
            return out

        words = F.split(F.regexp_replace(low, "[^a-z]+", " "), " ")
        out = _let(F.array_intersect(words, watched), lambda there: (F.size(there) > 0) & judged(there))
        for w in signs:
            out = F.contains(low, F.lit(w)) | out
        return out

    def row(n: int, common: Column, size: Column, start: Column, end: Column, line: Column) -> Column:
        name, grams = known[n][:2]
        return F.struct(
            common.cast("long").alias("common"), (2.0 * common / (size + len(grams))).alias("dice"), F.lit(-n).alias("order"), (-start).alias("before"),
            end.cast("int").alias("end"), F.lit(name).alias("license"), line.cast("int").alias("line"),
        )

    def reaches(n: int, common: Column, size: Column) -> Column:
        return common * 2 * den >= num * (size + len(known[n][1]))

    def line_match(words: Column, at: Column, i: Column) -> Column:
        """The best template of a line, or null."""

        def tried(grams: Column) -> Column:
            found = []
            for n, (_, want, _, (least, most)) in enumerate(known[: len(templates)]):
                common = F.size(F.array_intersect(grams, literal(want)))
                hit = F.size(grams).between(least, most) & reaches(n, common, F.size(grams))
                found.append(F.when(hit, F.struct((2.0 * common / (F.size(grams) + len(want))).alias("dice"), row(n, common, F.size(grams), start, start + F.size(words) - 2, i).alias("row"))))
            return F.array_max(F.array(*[F.struct(f["dice"].alias("dice"), f["row"]["order"].alias("order"), f["row"].alias("row")) for f in found]))["row"]

        start = F.array_position(at, i).cast("int") - 1
        least = min(b[0] for _, _, _, b in known[: len(templates)])
        shared = literal(sorted({g for _, want, _, _ in known[: len(templates)] for g in want}))
        return F.when(F.size(words) > least, _let(F.array_distinct(_pairs(words)), lambda g: F.when(F.arrays_overlap(g, shared), tried(g))))

    def windows(n: int, pairs: Column) -> Column:
        """The windows that match a template."""
        _, grams, places, (least, _) = known[n]
        longest = places * (2 * den - num) // num
        want, last = literal(grams), F.size(pairs) - 1

        def from_start(flags: Column, a: Column) -> Column:
            first = F.least(a + places - 1, last)
            ends = F.filter(F.sequence(first, F.least(a + longest - 1, last)), lambda b: (b == first) | (flags[b] & ((b == last) | ~F.coalesce(F.get(flags, b + 1), F.lit(False)))))

            def judged(b: Column) -> Column:
                part = F.slice(pairs, a + 1, b - a + 1)
                common, size = F.size(F.array_intersect(part, want)), F.size(F.array_distinct(part))
                return F.when(reaches(n, common, size), row(n, common, size, a, b, F.lit(-1)))

            return F.when(F.size(F.array_intersect(F.slice(pairs, a + 1, F.lit(longest)), want)) >= least, F.filter(F.transform(ends, judged), lambda x: x.isNotNull())).otherwise(F.array())

        def from_flags(flags: Column) -> Column:
            starts = F.filter(F.sequence(F.lit(0), last), lambda i: flags[i] & ((i == 0) | ~F.coalesce(F.get(flags, i - 1), F.lit(False))))
            return F.flatten(F.transform(starts, lambda a: from_start(flags, a)))

        return _let(F.transform(pairs, lambda p: F.array_contains(want, p)), from_flags)

    def chosen(lines: Column, found: Column) -> Column:
        """Matched lines, and then windows that overlap nothing that is as good."""

        def add(kept: Column, x: Column) -> Column:
            blocked = F.exists(kept, lambda k: (-k["before"] <= x["end"]) & (-x["before"] <= k["end"]) & ((k["line"] < 0) | (k["order"] == x["order"]) | (k["common"] >= x["common"])))
            return F.when(blocked, kept).otherwise(F.array_append(kept, x))

        return F.aggregate(F.sort_array(found, asc=False), lines, add)

    every = sorted({g for _, grams, _, _ in known for g in grams})

    def matches(by_line: Column) -> Column:
        def located(at: Column) -> Column:
            def from_pairs(pairs: Column) -> Column:
                def from_hits(hits: Column) -> Column:
                    found = [F.when(F.size(F.array_intersect(hits, literal(grams))) >= least, windows(n, pairs)).otherwise(F.array()) for n, (_, grams, _, (least, _)) in enumerate(known)]
                    return _let(F.filter(F.transform(by_line, lambda w, i: line_match(w, at, i)), lambda x: x.isNotNull()), lambda own: chosen(own, F.flatten(F.array(*found))))

                best = _let(F.array_intersect(pairs, literal(every)), from_hits)
                return F.transform(best, lambda x: F.struct(
                    F.element_at(at, 1 - x["before"]).cast("long").alias("part"), x["license"].alias("license"), (-x["order"]).cast("long").alias("template"), x["common"].alias("common"), x["dice"].alias("dice"),
                    F.when(x["line"] < 0, F.array_join(F.slice(F.flatten(by_line), 1 - x["before"], x["end"] + x["before"] + 2), " ")).otherwise(F.get(F.split(F.col(text), BREAKS), x["line"])).alias("matched"),
                ))

            return _let(_pairs(F.flatten(by_line)), from_pairs)

        return _let(F.flatten(F.transform(by_line, lambda w, i: F.array_repeat(i, F.size(w)))), located)

    found = _let(F.transform(F.split(F.col(text), BREAKS), words_of), matches)
    return docs.where(_let(F.lower(F.col(text)), hopeful)).select(F.col(key).alias("doc_id"), F.inline(found))
