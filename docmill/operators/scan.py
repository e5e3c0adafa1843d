"""What runs inside tasks over a stored index: scores and phrases of chunks, of which only the best leave a task.

Rows of the index hold the words of one chunk. The functions made here go to tasks by value,
with a block of queries; Spark deals out the rows and ranks what the tasks send.
"""

from __future__ import annotations

import math
from collections.abc import Iterator


def scorer(pairs: list[tuple], k: int, schema, idf: dict[str, float] | None = None, mean: float = 1.0, digits: int | None = None):
    """K-3 for mapInArrow over (chunk_uuid, terms). pairs: (query_id, term), a pair twice counts twice. Sends (query_id, chunk_uuid, score): the k best of the task for each query.

    Without idf 0.1 for each occurrence, else BM25. A task holds the scores of 256 chunks and
    about as many candidates as it will send.
    """
    ids = list(dict.fromkeys(q for q, _ in pairs))
    at, asks = {q: i for i, q in enumerate(ids)}, {}
    for q, term in pairs:
        asks.setdefault(term, []).append(at[q])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        known = pa.array(list(asks), pa.string())
        to = np.array([q for v in asks.values() for q in v], dtype=np.int64)
        many = np.array([len(v) for v in asks.values()], dtype=np.int64)
        begin = np.cumsum(many) - many
        worth = None if idf is None else np.array([idf.get(t, 0.0) for t in asks])
        floor = np.zeros(len(ids))
        held: list[tuple] = []  # of numbers of queries, scores, chunks
        size, bound = 0, 2 * k * len(ids) + 50_000

        def best():
            q, s, c = (np.concatenate([h[i] for h in held]) for i in range(3))
            shown = s if digits is None else np.round(s, digits)
            order = np.lexsort((c, -shown, q))
            q, s, c = q[order], s[order], c[order]
            first = np.searchsorted(q, q)
            keep = np.arange(len(q)) - first < k
            q, s, c, rank = q[keep], s[keep], c[keep], (np.arange(len(q)) - first)[keep]
            full = rank == k - 1
            floor[q[full]] = s[full]
            return q, s, c

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                names = np.empty(part.num_rows, dtype=object)
                names[:] = part.column(0).to_pylist()
                lists = part.column(1)
                length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                code = pc.fill_null(pc.index_in(lists.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False)
                hit = np.flatnonzero(code >= 0)
                # Each asked word of a chunk once, in the order in which they come, which sums hang on.
                key, first, n = np.unique(np.repeat(np.arange(part.num_rows), length)[hit] * len(many) + code[hit], return_index=True, return_counts=True)
                order = np.argsort(first)
                at, term, n = key[order] // len(many), key[order] % len(many), n[order].astype(float)
                weight = n if idf is None else worth[term] * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * length[at] / mean))
                flat = np.zeros(part.num_rows * len(ids))
                # Words meet the queries that ask for them, about four million pairs at a time.
                share = np.cumsum(many[term]) // 4_000_000
                for cut in np.split(np.arange(len(term)), np.flatnonzero(np.diff(share)) + 1):
                    each = many[term[cut]]
                    asked = to[np.repeat(begin[term[cut]] - (np.cumsum(each) - each), each) + np.arange(each.sum())]
                    np.add.at(flat, np.repeat(at[cut], each) * len(ids) + asked, np.repeat(weight[cut], each))
                scores = flat.reshape(part.num_rows, len(ids))
                # A score that is rounded like the last one kept may still go before it by its name.
                row, q = np.nonzero((scores > 0) & (scores >= floor - 2 * 10.0 ** -(digits if digits is not None else 15)))
                if len(row):
                    held.append((q, scores[row, q], names[row]))
                    size += len(row)
                if size > bound:
                    held = [best()]
                    size = len(held[0][0])
        if held:
            q, s, c = best()
            for start in range(0, len(q), 10_000):
                cut = slice(start, start + 10_000)
                data = [[ids[i] for i in q[cut]], c[cut].tolist(), s[cut] * (0.1 if idf is None else 1.0)]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(data, schema, strict=True)], schema=schema)

    return run


def finder(needles: list[tuple], longest: str, schema):
    """For mapInArrow over (chunk_uuid, segment, terms, gaps, written). needles: (needle, sign, words, gaps). longest: where the longest word must stand whole: in the `match`, in the `chunk`, or nowhere. Sends (needle, sign, chunk_uuid, segment) of the chunks that hold a needle, each once.

    A needle is looked up by its longest word, the rest is compared at that place. What a word
    of the corpus may be a part of is found once for each word of a task, by its beginnings,
    ends and substrings of the lengths that are asked for.
    """
    asked = []
    for needle, sign, words, gaps in needles:
        main = words.index(min(words, key=lambda w: (-len(w), w)))
        last = len(words) - 1
        left = gaps[0] == "" and not (longest == "match" and main == 0)
        right = gaps[-1] == "" and not (longest == "match" and main == last)
        asked.append((needle, sign, words, gaps, main, left, right, last))

    def run(batches: Iterator) -> Iterator:
        import re

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        tables: dict[str, dict[str, list[int]]] = {"whole": {}, "end": {}, "start": {}, "any": {}}
        for n, (_, sign, words, _, main, left, right, last) in enumerate(asked):
            a, b = left and main == 0 and longest != "chunk", right and main == last and longest != "chunk"
            kind = "any" if a and b else "end" if a else "start" if b else "whole"
            tables[kind].setdefault(words[main], []).append(n)
        sizes = {kind: sorted({len(t) for t in table}) for kind, table in tables.items()}
        signs = {s: re.compile(s) for _, s, *_ in asked if s is not None}
        known: dict[str, list[int]] = {}

        def candidates(term):
            out = list(tables["whole"].get(term, ()))
            size = len(term)
            for n in sizes["end"]:
                out += tables["end"].get(term[size - n :], ()) if n <= size else ()
            for n in sizes["start"]:
                out += tables["start"].get(term[:n], ()) if n <= size else ()
            for n in sizes["any"]:
                for part in {term[i : i + n] for i in range(size - n + 1)}:
                    out += tables["any"].get(part, ())
            if len(known) > 500_000:
                known.clear()
            known[term] = out
            return out

        def stands(n, pos, terms, gaps, written):
            _, sign, words, lead, main, left, right, last = asked[n]
            start = pos - main
            if start < 0 or start + last >= len(terms):
                return False
            for i, w in enumerate(words):
                t = terms[start + i]
                a, b = left and i == 0, right and i == last
                if not (w in t if a and b else t.endswith(w) if a else t.startswith(w) if b else t == w):
                    return False
                before = gaps[start + i]
                if not (before.endswith(lead[0]) if i == 0 else before == lead[i]):
                    return False
                if sign is not None:
                    if a and b and w not in re.split("[^a-z0-9]+", t):
                        return False
                    own = written[start + i] if written is not None else None
                    if not signs[sign].search(own if own is not None else t):
                        return False
            return gaps[start + last + 1].startswith(lead[last + 1])

        mains, of = pa.array(list(tables["whole"]), pa.string()), list(tables["whole"].values())

        def anywhere(part):
            """Where the longest word may stand anywhere in the chunk: words are looked up as a column, and texts are put together of the chunks that hold one."""
            lists = part.column(2)
            length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            code = pc.fill_null(pc.index_in(lists.flatten(), value_set=mains), -1).to_numpy(zero_copy_only=False)
            hit = np.flatnonzero(code >= 0)
            if not len(hit):
                return
            key = np.unique(np.repeat(np.arange(part.num_rows), length)[hit] * len(of) + code[hit])
            rows, first = np.unique(key // len(of), return_index=True)
            columns = [part.column(i).take(pa.array(rows)).to_pylist() for i in range(4)]
            for name, segment, terms, gaps, own in zip(*columns, np.split(key % len(of), first[1:]), strict=True):
                text = "".join([x for pair in zip(gaps, terms) for x in pair] + gaps[-1:])  # noqa: B905
                for c in own:
                    for n in of[c]:
                        if asked[n][0] in text:
                            yield asked[n][0], asked[n][1], name, segment

        for batch in batches:
            found = []
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                if longest == "chunk":
                    found += anywhere(part)
                    continue
                for row, terms in enumerate(part.column(2).to_pylist()):
                    some = [(pos, m) for pos, t in enumerate(terms) if (m := known[t] if t in known else candidates(t))]
                    if not some:
                        continue
                    gaps, written = part.column(3)[row].as_py(), part.column(4)[row].as_py()
                    met = set()
                    for pos, m in some:
                        met.update(n for n in m if n not in met and stands(n, pos, terms, gaps, written))
                    if met:
                        name, segment = part.column(0)[row].as_py(), part.column(1)[row].as_py()
                        found += [(asked[n][0], asked[n][1], name, segment) for n in met]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

    return run


def newest(needles: list[tuple], k: int, schema):
    """K-4 and K-5 for mapInArrow over (chunk_uuid, at, low, w, plain): the lower text of a chunk, its different words or null, and the text as it is written where signs are asked for. needles: (who, needle, sign, lead). Sends (who, chunk_uuid, at): the k newest chunks of the task for each who.

    A needle is compared with a text that has its lead, among its words or, without words, at
    any place.
    """

    def run(batches: Iterator) -> Iterator:
        import re
        from bisect import bisect_left

        import pyarrow as pa

        leads: dict[str, list[tuple]] = {}
        for who, needle, sign, lead in needles:
            leads.setdefault(lead, []).append((who, needle, sign and re.compile(sign)))
        sizes = sorted({len(x) for x in leads})
        kept: dict = {}  # of each who (-at, or infinity without a time, and chunk), at most k, the newest first
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                for name, at, low, words, plain in zip(*[c.to_pylist() for c in batch.slice(start, 256).columns], strict=True):
                    if low is None:
                        continue
                    key = (float("inf") if at is None else -at, name)
                    met = leads.keys() & (words if words is not None else {low[i : i + n] for n in sizes for i in range(len(low) - n + 1)})
                    for lead in met:
                        for who, needle, sign in leads[lead]:
                            best = kept.setdefault(who, [])
                            if len(best) == k and key >= best[-1] or needle not in low or sign is not None and not sign.search(plain):
                                continue
                            place = bisect_left(best, key)
                            if place == len(best) or best[place] != key:
                                best.insert(place, key)
                                del best[k:]
        found = [(who, name, None if at == float("inf") else -at) for who, best in kept.items() for at, name in best]
        for start in range(0, len(found), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found[start : start + 10_000], strict=True), schema, strict=True)], schema=schema)

    return run


def concepts_in(needles: list[tuple], schema):
    """A-7 for mapInArrow over (chunk_uuid, sentences), the words of each sentence in their order. needles: (number, words). Sends (chunk_uuid, c, s): the numbers of the concepts that follow each other in a sentence, and of the sentences, one row for each chunk that holds any."""
    codes: dict[str, int] = {}
    asked = [(n, [codes.setdefault(w, len(codes)) for w in words]) for n, words in needles]
    most = 1 + max((n for n, _ in asked), default=0)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        known = pa.array(list(codes), pa.string())
        # Concepts of one word, of each word the first, the second and so on; concepts may differ in signs only.
        layers: list = []
        for n, own in asked:
            if len(own) == 1:
                layer = next((x for x in layers if x[own[0]] < 0), None)
                if layer is None:
                    layers.append(layer := np.full(len(codes), -1))
                layer[own[0]] = n
        several = [(n, own) for n, own in asked if len(own) > 1]
        sizes = lambda a: pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False)

        for batch in batches:
            chunks = batch.column(1)
            sentences = chunks.flatten()
            words = sentences.flatten()
            per = sizes(chunks)
            row = np.repeat(np.arange(len(chunks)), per)
            place = np.arange(len(sentences)) - np.repeat(np.cumsum(per) - per, per)
            of = np.repeat(np.arange(len(sentences)), sizes(sentences))
            code = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False)
            hit = np.flatnonzero(code >= 0)
            found = []
            for layer in layers:
                number = layer[code[hit]]
                found.append(of[hit[number >= 0]] * most + number[number >= 0])
            if several:
                hit = hit[np.argsort(code[hit], kind="stable")]
                first, last = np.searchsorted(code[hit], np.arange(len(codes))), np.searchsorted(code[hit], np.arange(len(codes)), "right")
                for n, own in several:
                    at = hit[first[own[0]] : last[own[0]]]
                    at = at[at + len(own) <= len(code)]
                    for i, c in enumerate(own[1:], 1):
                        at = at[code[at + i] == c]
                    found.append(of[at[of[at] == of[at + len(own) - 1]]] * most + n)
            key = np.unique(np.concatenate(found)) if found else np.empty(0, dtype=np.int64)
            if not len(key):
                continue
            s, c = key // most, key % most
            rows, start = np.unique(row[s], return_index=True)
            ends = pa.array(np.append(start, len(key)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (c, place[s])]
            data = [batch.column(0).take(pa.array(rows)), *lists]
            yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(data, schema, strict=True)], schema=schema)

    return run


def pairs_in(pairs: list[tuple], schema):
    """A-7 for mapInArrow over (who, chunk_uuid, c, s) as concepts_in sends them, sorted by chunk_uuid and who; a chunk may have several rows. pairs: (who, x, y), numbers of concepts. Sends (who, x, y, n, same, chunk_uuid): in how many chunks of the task a pair is, whether in one sentence, and the first chunk that has it so, else the first that has it."""
    partners: dict = {}
    for who, x, y in pairs:
        partners.setdefault(who, {}).setdefault(x, set()).add(y)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        met: dict[tuple, list] = {}
        none: set = set()

        def count(key, held):
            who, chunk = key
            of = partners.get(who, {})
            for x, at in held.items():
                for y in of.get(x, none) & held.keys():
                    same = at & held[y] != 0
                    old = met.get((who, x, y))
                    if old is None:
                        met[who, x, y] = [1, same, chunk]
                    else:
                        old[0] += 1
                        if same and not old[1]:
                            old[1:] = True, chunk

        last, held = None, {}
        for batch in batches:
            for who, chunk, numbers, places in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (who, chunk) != last:
                    if held:
                        count(last, held)
                    last, held = (who, chunk), {}
                for c, s in zip(numbers, places, strict=True):
                    held[c] = held.get(c, 0) | 1 << s
        if held:
            count(last, held)
        found = [(*key, *own) for key, own in met.items()]
        for start in range(0, len(found), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found[start : start + 10_000], strict=True), schema, strict=True)], schema=schema)

    return run


def parts_of(needles: list[str], schema):
    """For mapInArrow over (text), which are short. Sends (text, needle): each needle that a text contains, once."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known = set(needles)
        sizes = sorted({len(n) for n in known})
        for batch in batches:
            found = []
            for text in batch.column(0).to_pylist():
                if text is not None:
                    found += [(text, p) for p in {text[i : i + n] for n in sizes for i in range(len(text) - n + 1)} & known]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

    return run


def packed(schema):
    """For mapInArrow over (query_id, terms). Sends (query_id, terms): the different terms that may be words, in order, as compressed lines; nothing for a null."""

    def run(batches: Iterator) -> Iterator:
        import zlib

        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                some = [(who, zlib.compress("\n".join(sorted({t for t in terms if t and "\n" not in t})).encode())) for who, terms in zip(*[c.to_pylist() for c in batch.slice(start, 256).columns], strict=True) if terms is not None]
                if some:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)

    return run


def occurrences(schema):
    """K-6 for mapInArrow over (query_id, terms, held): the terms of a query as packed sends them, and of one file (chunk_uuid, w), the words of a chunk as lines. Sends (query_id, chunk_uuid, n) of the chunks with n words, more than none, among the terms; a chunk in several rows counts as one."""

    def run(batches: Iterator) -> Iterator:
        import zlib

        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                found = []
                for who, terms, held in zip(*[c.to_pylist() for c in batch.slice(start, 256).columns], strict=True):
                    own, met = set(zlib.decompress(terms).decode().split("\n")) - {""}, {}
                    for h in held:
                        if n := sum(map(own.__contains__, h["w"].split("\n"))):
                            met[h["chunk_uuid"]] = met.get(h["chunk_uuid"], 0) + n
                    found += [(who, c, n) for c, n in met.items()]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

    return run


def nearest(k: int, digits: int | None, schema):
    """K-1 for mapInArrow over (qs, vs), arrays of (query_id, e) and (chunk_uuid, e). Sends (query_id, chunk_uuid, score): the k best of the task for each query that it has met."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        best: dict = {}  # of a query: scores and names, at most k

        def matrix(array):
            e = array.field("e")
            flat = e.flatten().to_numpy(zero_copy_only=False)
            return flat.reshape(len(array), -1)

        for batch in batches:
            for row in range(batch.num_rows):
                qs, vs = batch.column(0)[row].values, batch.column(1)[row].values
                asked, names = qs.field(0).to_pylist(), np.empty(len(vs), dtype=object)
                names[:] = vs.field(0).to_pylist()
                scores = matrix(qs) @ matrix(vs).T
                shown = scores if digits is None else np.round(scores, digits)
                for q, raw, s in zip(asked, scores, shown, strict=True):
                    if q in best:
                        old = best[q]
                        if len(old[0]) == k:
                            near = np.flatnonzero(s >= old[1][-1])
                            if not len(near):
                                continue
                            raw, s, own = raw[near], s[near], names[near]
                        else:
                            own = names
                        raw, s, own = (np.concatenate(x) for x in zip(old, (raw, s, own), strict=True))
                    else:
                        own = names
                    if len(s) > k:
                        last = np.partition(s, len(s) - k)[len(s) - k]
                        some = np.flatnonzero(s >= last)
                        raw, s, own = raw[some], s[some], own[some]
                    order = np.lexsort((own, -s))[:k]
                    best[q] = raw[order], s[order], own[order]
        asked = list(best)
        for start in range(0, len(asked), 64):
            some = asked[start : start + 64]
            data = [[q for q in some for _ in best[q][0]], [c for q in some for c in best[q][2]], [float(x) for q in some for x in best[q][0]]]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(data, schema, strict=True)], schema=schema)

    return run


def nearest_of_blocks(k: int, digits: int | None, schema):
    """K-1 for a cogroup of (query_id, e, ..) and (chunk_uuid, e, ..), a block of each. The k best of the block for each query: (query_id, chunk_uuid, score). Scores of at most about four million pairs are held at once."""

    def run(queries, vectors):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if not queries.num_rows or not vectors.num_rows:
            return schema.empty_table()

        def matrix(table):
            flat = table.column("e").combine_chunks().flatten()
            return flat.to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)

        v, q, names = matrix(vectors), matrix(queries), vectors.column("chunk_uuid").combine_chunks()
        place = np.empty(len(names), dtype=np.int64)
        place[pc.array_sort_indices(names, null_placement="at_start").to_numpy()] = np.arange(len(names))
        rows, found, score = [], [], []
        strip = max(1, 4_000_000 // len(v))
        for start in range(0, len(q), strip):
            scores = q[start : start + strip] @ v.T
            for i, raw in enumerate(scores, start):
                s = raw if digits is None else np.round(raw, digits)
                some = np.arange(len(s))
                if len(s) > k:
                    some = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
                best = some[np.lexsort((place[some], -s[some]))[:k]]
                rows.append(np.full(len(best), i))
                found.append(best)
                score.append(raw[best])
        ids = queries.column("query_id").combine_chunks()
        data = [ids.take(pa.array(np.concatenate(rows))), names.take(pa.array(np.concatenate(found))), pa.array(np.concatenate(score))]
        return pa.Table.from_arrays([x.cast(f.type) for x, f in zip(data, schema, strict=True)], schema=schema)

    return run


def blocks(n: int, most: int) -> int:
    return max(1, math.ceil(n / most))
