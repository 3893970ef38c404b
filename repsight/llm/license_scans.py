"""#8 License scans as an exact set-similarity join with license templates.

A document's words are cut into overlapping blocks; a template is found in a
block when the block holds at least ``threshold`` of the template's distinct
words. The join is exact: words are ordered by their frequency over the whole
corpus, rarest first; a block can reach the threshold only if it holds one of
the template's first ``|T| - needed + 1`` words (prefix filter), holds enough
template words at all (length filter), and enough words are left on both sides
from the place of the first common word on (positional filter). What passes is
counted in full. ``blocks`` holds every block and template found. Labels leave
out a template in a block only where a template found more completely has all
words that it matched there and, by the words' counts, takes up their places;
a notice that stands there itself keeps its label. Blocks start every half of
their length, so every stretch of up to half a block lies inside one; a
template's blocks have ``block`` words, doubled until a half holds the template
with a quarter of its words put in, so templates of any length are found. The
template list is a parameter; its words' corpus frequencies are the only
thing that is collected.

Edge cases: null and empty texts have no words and score 0; null doc_ids and
repeated rows are scanned row by row; further columns are ignored, whatever
their names; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base phrases and their labels (fixed by the contract).
PHRASES: tuple[tuple[str, str], ...] = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Labels and wordings of common license notices, lower case, words only.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("mit-notice", "released under the mit license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc0-1.0", "dedicated to the public domain under cc0 1 0"),
)
# Wordings of whole public license texts, in their order, lower case, words only.
_DISCLAIMER_BSD = """this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to
the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for
any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use
data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or
otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"""
_GRANT_BSD = """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other
materials provided with the distribution"""
FULL_TEXTS: tuple[tuple[str, str], ...] = (
    ("mit-text", """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal
in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software
and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be
included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited
to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim
damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in
the software"""),
    ("isc-text", """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright
notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all
implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages
whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use
or performance of this software"""),
    ("bsd-2-text", f"{_GRANT_BSD} {_DISCLAIMER_BSD}"),
    ("bsd-3-text", f"""{_GRANT_BSD} 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from
this software without specific prior written permission {_DISCLAIMER_BSD}"""),
    ("apache-2.0-header", """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a
copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is
distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and
limitations under the license"""),
    ("gpl-3.0-header", """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free
software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any
warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have
received a copy of the gnu general public license along with this program if not see"""),
)
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased, as UTF-8."""
    return _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


@dataclass(frozen=True)
class Template:
    """A template's distinct words, rarest first, and the numbers of its filters."""

    label: str
    ordered: tuple[bytes, ...]
    needed: int
    n_words: int = 0

    @property
    def prefix(self) -> tuple[bytes, ...]:
        return self.ordered[: len(self.ordered) - self.needed + 1]


def prepared(templates: tuple[tuple[str, str], ...], frequency: dict[bytes, int], threshold_percent: int) -> tuple[list[Template], dict[bytes, int]]:
    """Templates with their words in global frequency order, and that order: word -> rank."""
    vocabulary = {w.encode() for _, wording in templates for w in wording.split()}
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w)))}
    out = []
    for label, wording in templates:
        distinct = sorted({w.encode() for w in wording.split()}, key=rank.__getitem__)
        out.append(Template(label, tuple(distinct), -(-threshold_percent * len(distinct) // 100), len(wording.split())))
    return out, rank


def frequencies(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES + FULL_TEXTS) -> dict[bytes, int]:
    """Corpus frequency of every template word: counted per task over all texts, summed in Spark, one number per template word collected."""
    vocabulary = {w.encode() for _, wording in templates for w in wording.split()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch["text"]:
                n.update(filter(vocabulary.__contains__, words_of(text)))
        if n:
            yield pd.DataFrame({"word": [w.decode() for w in n], "n": list(n.values())})

    counts = docs.select("text").mapInPandas(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"].encode(): r["n"] for r in counts.collect()}


def block_matches(hits: list[tuple[int, bytes]], templates: list[Template], rank: dict[bytes, int], by_prefix: dict[bytes, list[int]], block: int) -> Iterator[tuple[int, dict[int, int], Counter[bytes]]]:
    """(first word, template -> distinct words held, counts of template words) of every block that reaches a threshold."""
    step, at, to = block // 2, 0, 0
    place = [p for p, _ in hits]
    # only blocks with some template's prefix word can reach a threshold
    starts = sorted({s for p, w in hits if w in by_prefix for s in (p // step * step, max(0, p // step - 1) * step)})
    for start in starts:
        at = bisect_left(place, start, at)
        to = bisect_left(place, start + block, max(to, at))
        count = Counter(w for _, w in hits[at:to])
        held = sorted(count, key=rank.__getitem__)
        where = {w: i for i, w in enumerate(held)}
        here: dict[int, int] = {}
        for t in {t for w in held for t in by_prefix.get(w, ())}:
            template = templates[t]
            if len(held) < template.needed:
                continue
            i, first = next((i, w) for i, w in enumerate(template.prefix) if w in where)
            if 1 + min(len(template.ordered) - i - 1, len(held) - where[first] - 1) < template.needed:
                continue
            n = sum(w in where for w in template.ordered)
            if n >= template.needed:
                here[t] = n
        if here:
            yield start, here, count


def own_matches(here: dict[int, int], count: Counter[bytes], templates: list[Template]) -> list[int]:
    """The templates of one block that no stronger one stands for.

    Strongest first, each takes the words of as many copies as the block holds
    of it. A template is left out only if the words left don't reach its
    threshold and a stronger template has every word it matched.
    """
    strength = {t: (n / len(templates[t].ordered), n) for t, n in here.items()}
    order = sorted(here, key=lambda t: (*(-x for x in strength[t]), t))
    rest, own = count.copy(), []
    for t in order:
        matched = [w for w in templates[t].ordered if count[w]]
        if sum(rest[w] > 0 for w in matched) < templates[t].needed and any(strength[u] > strength[t] and set(matched) <= set(templates[u].ordered) for u in order):
            continue
        own.append(t)
        copies = max(1, min(rest[w] for w in matched))
        for w in matched:
            rest[w] = max(0, rest[w] - copies)
    return own


def matches(hits: list[tuple[int, bytes]], templates: list[Template], rank: dict[bytes, int], by_prefix: dict[bytes, list[int]], block: int) -> dict[str, float]:
    """label -> largest containment over the blocks of one text; ``hits`` are its template words with their places."""
    return best_of(block_matches(hits, templates, rank, by_prefix, block), templates)


def best_of(blocks: Iterable[tuple[int, dict[int, int], Counter[bytes]]], templates: list[Template]) -> dict[str, float]:
    """label -> largest containment of the templates that stand for themselves in some block."""
    found: dict[str, float] = {}
    for _, here, count in blocks:
        for t in own_matches(here, count, templates):
            found[templates[t].label] = max(found.get(templates[t].label, 0.0), here[t] / len(templates[t].ordered))
    return found


def block_of(n_words: int, block: int) -> int:
    """The block length for a template of so many words: ``block``, doubled until a half holds the template and a quarter more."""
    while 2 * block < 5 * n_words:
        block *= 2
    return block


def by_block(ready: list[Template], block: int) -> list[tuple[int, dict[bytes, list[int]], set[bytes]]]:
    """(block length, prefix word -> its templates, all their words) of every block length in use."""
    found: dict[int, tuple[dict[bytes, list[int]], set[bytes]]] = {}
    for t, template in enumerate(ready):
        prefixes, vocabulary = found.setdefault(block_of(template.n_words, block), ({}, set()))
        vocabulary.update(template.ordered)
        for w in template.prefix:
            prefixes.setdefault(w, []).append(t)
    return [(length, *found[length]) for length in sorted(found)]


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES + FULL_TEXTS, phrases: tuple[tuple[str, str], ...] = PHRASES, threshold_percent: int = 85, block: int = 64) -> DataFrame:
    """Per document: doc_id, n_words, places (struct<label, word> of base phrases), blocks (struct<label, word, share>: every block and template at or above the threshold), found (map label -> containment)."""
    ready, rank = prepared(templates, frequencies(docs, templates), threshold_percent)
    classes = by_block(ready, block)
    spoken = [([w.encode() for w in p.split()], label) for p, label in phrases]
    wanted, heads = {*rank, *(w for p, _ in spoken for w in p)}, {p[0] for p, _ in spoken}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: dict[str, list] = {"doc_id": batch["doc_id"].astype("Int64"), "n_words": [], "places": [], "blocks": [], "found": []}
            for text in batch["text"]:
                words = words_of(text)
                hits = [(i, w) for i, w in enumerate(words) if w in wanted]
                out["n_words"].append(len(words))
                out["places"].append([{"label": label, "word": i} for i, w in hits if w in heads for p, label in spoken if words[i : i + len(p)] == p])
                met = [found for length, prefixes, vocabulary in classes
                       for found in block_matches([h for h in hits if h[1] in vocabulary], ready, rank, prefixes, length)]
                out["blocks"].append([{"label": ready[t].label, "word": start, "share": n / len(ready[t].ordered)} for start, here, _ in met for t, n in sorted(here.items())])
                out["found"].append(best_of(met, ready))
            yield pd.DataFrame(out)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id bigint, n_words bigint, places array<struct<label: string, word: bigint>>, blocks array<struct<label: string, word: bigint, share: double>>, found map<string, double>")


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's rows."""
    base = F.array_distinct(F.transform("places", lambda p: p["label"]))
    starts = F.transform("places", lambda p: p["word"])
    best = F.array_max(F.map_values("found"))
    return scanned.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.sort_array(base), ",").alias("base_labels"), F.array_join(F.sort_array(F.array_union(base, F.map_keys("found"))), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"))
