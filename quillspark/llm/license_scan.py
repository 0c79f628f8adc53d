"""Licence scan through a positional index of rare licence words."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import map_rows

#: The base phrases and their labels.
BASE_PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

#: (label, notice, mandatory key phrases within it): the usual public notices of common licences.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ("permission is hereby granted free of charge", "to deal in the software without restriction")),
    ("mit", "released under the mit license", ("the mit license",)),
    ("mit", "licensed under the mit license", ("the mit license",)),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("this permission notice shall be included in all copies",)),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", ("the software is provided as is without warranty of any kind", "other dealings in the software")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("permission to use copy modify and or distribute this software",)),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license version 2",)),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ("required by applicable law or agreed to in writing", "without warranties or conditions of any kind")),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ("redistributions of source code must retain the above copyright notice",)),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ("redistributions in binary form must reproduce the above copyright notice",)),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("may be used to endorse or promote products derived from this software",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license",)),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ("gnu general public license", "version 2 of the license")),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu general public license", "version 3 of the license")),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", ("distributed in the hope that it will be useful", "gnu general public license")),
    ("gpl", "licensed under the gnu general public license", ("gnu general public license",)),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    ("agpl", "licensed under the gnu affero general public license", ("gnu affero general public license",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by", "licensed under cc by 4 0", ("cc by 4",)),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4",)),
    ("cc0", "this work is dedicated to the public domain under cc0 1 0 universal", ("cc0 1 0",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("all-rights-reserved", "copyright all rights reserved", ("all rights reserved",)),
)

#: So many of a notice's highest-IDF words are posted in the index, and three quarters of a short one's.
ANCHORS = 8
#: Posted words that must agree on a notice's place, or all of a notice that has fewer.
AGREE = 2
#: Least part of a notice's word weight that must be found in its order around its place.
COVERAGE = 0.6
#: Words that may have been inserted before a notice's word, for each word of the notice.
DRIFT = 0.15

_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Words of the whole text after lower-casing A-Z: runs of digits, a-z and anything beyond ASCII."""
    return text.encode().translate(_WORD_BYTES).split() if text else []


class LicenseIndex:
    """Postings (template, position) of each template's rarest words, and what must hold at a template's place."""

    def __init__(self, base=BASE_PHRASES, notices=NOTICES, anchors: int = ANCHORS):
        self.templates = [(label, words_of(phrase), [words_of(phrase)], True) for label, phrase in base]
        self.templates += [(label, words_of(t), [words_of(k) for k in keys], False) for label, t, keys in notices]
        n = len(self.templates)
        holders = defaultdict(set)
        for t, (_, words, _, _) in enumerate(self.templates):
            for w in words:
                holders[w].add(t)
        self.idf = {w: math.log(1 + n / len(ts)) for w, ts in holders.items()}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.posted: list[int] = []
        for t, (_, words, _, base_phrase) in enumerate(self.templates):
            # Of equally rare words the longer one is rarer in running text.
            ranked = sorted(set(words), key=lambda w: (-self.idf[w], -len(w), w))
            chosen = set(ranked[: 1 if base_phrase else max(1, min(anchors, len(ranked) * 3 // 4))])
            places = [i for i, w in enumerate(words) if w in chosen]
            for i in places[:1] if base_phrase else places:  # a base phrase's every occurrence is met exactly once
                self.postings[words[i]].append((t, i))
            self.posted.append(len(places))

    def slack(self, t: int) -> int:
        """How far the places that a template's words give may lie apart."""
        return 2 + int(DRIFT * len(self.templates[t][1]))

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], dict[str, float]]:
        """Base places as (start, label), and the best coverage of each label found through a notice.

        All posted words that the text has are looked up, not only its rarest; they give places of templates by relative position.
        """
        if self.postings.keys().isdisjoint(words):
            return [], {}
        base: list[tuple[int, str]] = []
        places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for at, word in enumerate(words):
            for t, i in self.postings.get(word, ()):
                label, own, _, exact = self.templates[t]
                if exact:
                    if at >= i and words[at - i : at - i + len(own)] == own:
                        base.append((at - i, label))
                else:
                    places[t].append((at - i, i))
        found: dict[str, float] = {}
        for t, given in places.items():
            label, own, keys, _ = self.templates[t]
            slack = self.slack(t)
            for start in self._agreed(t, given):
                if found.get(label, 0) >= 1:
                    break
                window = words[max(0, start - slack) : max(0, start + len(own) + slack)]
                if not all(_contains(window, key) for key in keys):
                    continue
                if self._coverage(own, set(window)) >= COVERAGE:  # in any order, which is told sooner
                    coverage = self._coverage(own, self._in_order(own, window))
                    if coverage >= COVERAGE:
                        found[label] = max(found.get(label, 0.0), coverage)
        return base, found

    def _agreed(self, t: int, given: list[tuple[int, int]]) -> list[int]:
        """The distinct places of (place, position in the template) with enough different positions within the slack."""
        slack, need = self.slack(t), min(AGREE, self.posted[t])
        given = sorted(set(given))
        agreed, first, last, near = [], 0, 0, Counter()
        for start in sorted({s for s, _ in given}):
            while last < len(given) and given[last][0] <= start + slack:
                near[given[last][1]] += 1
                last += 1
            while given[first][0] < start - slack:
                near[given[first][1]] -= 1
                if not near[given[first][1]]:
                    del near[given[first][1]]
                first += 1
            if len(near) >= need:
                agreed.append(start)
        return agreed

    def _coverage(self, own: list[bytes], there: set[bytes]) -> float:
        distinct = sorted(set(own))
        return sum(self.idf[w] for w in distinct if w in there) / sum(self.idf[w] for w in distinct)

    def _in_order(self, own: list[bytes], window: list[bytes]) -> set[bytes]:
        """Words of the heaviest common subsequence of a notice and a window."""
        best = [[0.0] * (len(window) + 1) for _ in range(len(own) + 1)]
        for i, w in enumerate(own):
            above, row, weight = best[i], best[i + 1], self.idf[w]
            for j, v in enumerate(window):
                row[j + 1] = above[j] + weight if v == w else max(row[j], above[j + 1])
        words, i, j = set(), len(own), len(window)
        while i and j:
            if own[i - 1] == window[j - 1]:
                words.add(own[i - 1])
                i, j = i - 1, j - 1
            elif best[i - 1][j] >= best[i][j - 1]:
                i -= 1
            else:
                j -= 1
        return words


def _contains(words: list[bytes], phrase: list[bytes]) -> bool:
    first, n = phrase[0], len(phrase)
    return any(w == first and words[i : i + n] == phrase for i, w in enumerate(words))


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: LicenseIndex | None = None
) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score), a row per input row, without a shuffle.

    Each word that the index lists as rare is looked up; each of its postings gives a place of a template by
    relative position; where enough different words of a notice agree on a place, its mandatory key phrases must stand in full
    and enough of the notice's weight must be near, in the notice's order. Base phrases are templates that must stand there word for word.
    score: 1 for a base phrase, else the best coverage, else 0. Null or empty text: no words, null places, empty
    labels, score 0. Repeated rows get equal results. An empty table gives no rows. One document's words are in memory
    at a time.
    """
    index = index or LicenseIndex()

    def start():
        def step(rows):
            for key, text in rows:
                words = words_of(text)
                base, found = index.scan(words)
                starts = [s for s, _ in base]
                base_labels = {label for _, label in base}
                yield (
                    key, len(words), len(base), min(starts, default=None), max(starts, default=None),
                    ",".join(sorted(base_labels)), ",".join(sorted(base_labels | found.keys())),
                    1.0 if base else float(max(found.values(), default=0.0)),
                )

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(
        docs.select(F.col(id_col), F.col(text_col)),
        f"`{id_col}` {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
        start,
    )
