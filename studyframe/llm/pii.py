"""Personal data: fixed base patterns, widened by bootstrapped contextual extraction.

1. One scan finds the base spans of each whole text and, for each kind, look-alikes that the base doesn't take (a number that fails its check, an address without a
   dot, a phone number without a plus). Each comes with the word contexts before it.
2. The base values are the seed instances. A pattern is a context of one or two words; another scan counts how often it occurs in the whole corpus (one for
   each round that brings up new patterns). Its confidence
   is the share of these places that hold a known instance, so a common word that happens to stand before a number is no pattern.
3. Spark scores the graph of patterns and instances in rounds: instances reached by trusted patterns (noisy-or of their confidences) become known and may make
   further patterns trusted, until a round reaches nothing new. The graph is a table of occurrences, aggregated by pattern and by instance with partial sums; nothing of it comes to the driver.
   (For the count of step 2 the patterns go to the tasks in blocks of PATTERN_BLOCK.)
4. Look-alikes of known instances are added as spans, unless they overlap base spans of the text; base spans always stay.

Positions are code points, ends exclusive. Cases: null and empty texts have no spans; repeated rows and tied ids each give a row; an empty table gives no rows; other columns are ignored or
passed on.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyframe.llm import tokens
from studyframe.llm.work import handed_off, small_batches, spare

KINDS = ["email", "ip", "card", "phone"]
#: A pattern needs so many known instances and this confidence; an instance this belief.
SUPPORT, CONFIDENCE, BELIEF = 5, 0.5, 0.75
PATTERN_BLOCK = 1 << 20

# The base forms, made safe for long runs: where a form starts with a run of one class, a start inside the run can't succeed if the run's start failed.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0d]+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Look-alikes of each kind.
_LIKE = {
    "email": re.compile(r"(?<![\w.%+-])[\w.%+-]++(?:@|\(at\)|\[at\])\w(?:[.-]*+\w)++"),
    "ip": re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}(?![0-9A-Fa-f:])"),
    "card": re.compile(r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{3,6}){2,4}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9])\(?[0-9]{2,4}\)?[ ./-][0-9]{3,4}[ ./-]?[0-9]{3,4}(?![0-9])"),
}

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, x in enumerate(reversed(digits)):
        v = int(x) << (k & 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
        else:
            last = at + 1
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the base forms, in order."""
    out = [(a, 0, b) for a, b in _emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) < 4 and int(x) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(out)


def like_spans(text: str, base: list[Span]) -> list[Span]:
    """(start, kind, end) of look-alikes that overlap no base span and no earlier look-alike."""
    out: list[Span] = []
    for k, kind in enumerate(KINDS):
        if kind == "email" and not ("@" in text or "(at)" in text or "[at]" in text) or kind == "ip" and ":" not in text:
            continue
        out += [(m.start(), k, m.end()) for m in _LIKE[kind].finditer(text)]
    free, end, b = [], 0, 0
    for s in sorted(out):
        while b < len(base) and base[b][2] <= s[0]:
            b += 1
        if s[0] >= end and not (b < len(base) and base[b][0] < s[2]):
            free.append(s)
            end = s[2]
    return free


def contexts(text: str, starts: list[int]) -> list[list[str]]:
    """For each of the ascending ``starts`` the one and two white-space words that end before the word it lies in, in lower case."""
    out: list[list[str]] = []
    words: list[str] = []
    found = _WORD.finditer(text)
    word = next(found, None)
    for start in starts:
        while word and word.end() <= start:
            words = [*words[-1:], word[0].lower()]
            word = next(found, None)
        out.append([words[-1], " ".join(words)] if len(words) == 2 else list(words))
    return out


def _value(text: str, span: Span) -> str:
    part = text[span[0]:span[2]].lower()
    return part if span[1] < 2 else re.sub(r"[^0-9]", "", part)


_FOUND = "base array<struct<start:int,kind:int,stop:int>>, more array<struct<start:int,kind:int,stop:int>>"
_SEEN = "seen array<struct<kind:int,value:string,known:boolean,contexts:array<string>>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spans = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32())]))
    seen = pa.list_(pa.struct([("kind", pa.int32()), ("value", pa.string()), ("known", pa.bool_()), ("contexts", pa.list_(pa.string()))]))
    put = lambda x: [{"start": a, "kind": k, "stop": b} for a, k, b in x]
    for batch in batches:
        base, more, graph = [], [], []
        for text in batch.column("text").to_pylist():
            text = text or ""
            b = base_spans(text)
            m = like_spans(text, b)
            base.append(put(b))
            more.append(put(m))
            graph.append([{"kind": s[1], "value": _value(text, s), "known": own, "contexts": c}
                          for own, x in ((True, b), (False, m)) for s, c in zip(x, contexts(text, [s[0] for s in x]) if x else [], strict=True)])
        yield pa.record_batch([batch.column("doc_id"), pa.array(base, spans), pa.array(more, spans), pa.array(graph, seen)], ["doc_id", "base", "more", "seen"])


def _counter(shared):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, one, two = shared.value
        total = np.zeros(len(order), np.int64)
        for batch in batches:
            for part in tokens.slices(batch.column("text"), most=tokens.SMALL_SLICE):
                pairs = tokens.shingles(part.hash, part.row, 2)[0]
                for own, hashes in ((one, part.hash), (two, pairs)):
                    if len(own[0]) and len(hashes):
                        at = np.minimum(np.searchsorted(own[0], hashes), len(own[0]) - 1)
                        np.add.at(total, own[1][at[own[0][at] == hashes]], 1)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array([order[i] for i in some], pa.string()), pa.array(total[some])], ["pattern", "places"])
    return count


def _hash_index(patterns: list[str]) -> tuple[list[str], tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """The patterns, and the sorted hashes and numbers of those of one and of two words."""
    single, double = ([], []), ([], [])
    for part in tokens.slices(pa.array(patterns, pa.string()), most=tokens.SMALL_SLICE):
        h2, row2, _ = tokens.shingles(part.hash, part.row, 2)
        pairs = set((row2 + part.first).tolist())
        for to, hs, rows in ((single, part.hash, part.row), (double, h2, row2)):
            for h, r in zip(hs.tolist(), (rows + part.first).tolist(), strict=True):
                if (r in pairs) == (to is double):
                    to[0].append(h)
                    to[1].append(r)
    out = []
    for h, r in (single, double):
        h, r = np.array(h, np.uint64), np.array(r, np.int64)
        order = np.argsort(h, kind="stable")
        out.append((h[order], r[order]))
    return patterns, out[0], out[1]


def _places(docs: DataFrame, patterns: DataFrame) -> DataFrame | None:
    """How often each pattern occurs in the whole corpus, counted with a block of patterns at a time."""
    context, out, block = docs.sparkSession.sparkContext, None, []

    def scan(block: list[str]) -> DataFrame:
        shared = context.broadcast(_hash_index(block))
        return docs.select("text").mapInArrow(_counter(shared), "pattern string, places long").groupBy("pattern").agg(F.sum("places").alias("places"))

    for r in patterns.toLocalIterator():
        block.append(r[0])
        if len(block) == PATTERN_BLOCK:
            out, block = scan(block) if out is None else out.unionAll(scan(block)), []
    if block:
        out = scan(block) if out is None else out.unionAll(scan(block))
    return out


def find(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, row, base, more, seen) of every document, and the (kind, value) pairs of new instances (None if there are none)."""
    with small_batches(docs.sparkSession):
        return _bootstrapped(docs)


def _bootstrapped(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").mapInArrow(_scan, f"doc_id {kind}, {_FOUND}, {_SEEN}")
    found = handed_off(found.withColumn("row", F.monotonically_increasing_id()), "pii-spans")
    edges = (found.select(F.explode("seen").alias("s")).select("s.kind", "s.value", "s.known", F.explode("s.contexts").alias("pattern"))
             .groupBy("kind", "value", "pattern").agg(F.max("known").alias("known"), F.count("*").alias("n")))
    edges = handed_off(edges, "pii-graph")
    if edges.filter("not known").isEmpty():
        return found, None
    known = handed_off(edges.filter("known").select("kind", "value").distinct(), "pii-known")
    asked = places = None
    while True:
        mine = edges.join(known.withColumn("is", F.lit(True)), ["kind", "value"], "left")
        able = (mine.groupBy("kind", "pattern").agg(F.count_if("is").alias("f"), F.sum(F.when(F.col("is"), F.col("n"))).alias("hits"))
                .filter(F.col("f") >= SUPPORT))
        able = handed_off(able, "pii-support")
        # patterns that the last round's instances brought up are counted, too
        fresh = able.select("pattern").distinct()
        fresh = handed_off(fresh if asked is None else fresh.join(asked, "pattern", "left_anti"), "pii-patterns")
        counted = _places(docs, fresh)
        if counted is not None:
            asked = fresh if asked is None else handed_off(asked.unionAll(fresh), "pii-patterns")
            places = handed_off(counted if places is None else places.unionAll(counted), "pii-places")
        if places is None:
            return found, None
        trusted = able.join(places, "pattern").withColumn("confidence", F.least(F.lit(1.0), F.col("hits") / F.col("places"))).filter(F.col("confidence") >= CONFIDENCE)
        reached = (mine.filter("is is null").join(trusted.select("kind", "pattern", "confidence"), ["kind", "pattern"])
                   .groupBy("kind", "value").agg(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("confidence")))).alias("doubt"))
                   .filter(1 - F.exp("doubt") >= BELIEF).select("kind", "value"))
        reached = handed_off(reached, "pii-reached")
        if reached.isEmpty():
            return found, known
        known = handed_off(known.unionAll(reached), "pii-known")


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, base, all): spans as arrays of (start, kind, stop), in order of start and kind."""
    found, known = find(docs)
    base = F.sort_array("base")
    if known is None:
        return found.select("doc_id", base.alias("base"), base.alias("all"))
    likes = (found.select("row", F.posexplode("more").alias("k", "span"), F.filter("seen", lambda s: ~s.known).alias("seen"))
             .select("row", "span", F.get("seen", F.col("k")).alias("s")).select("row", "span", "s.kind", "s.value"))
    extra = likes.join(known, ["kind", "value"], "left_semi").groupBy("row").agg(F.collect_list("span").alias("extra"))
    return (found.join(extra, "row", "left")
            .select("doc_id", base.alias("base"), F.sort_array(F.when(F.col("extra").isNull(), F.col("base")).otherwise(F.concat("base", "extra"))).alias("all")))


def _text_of(column: str):
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", F.get(F.array(*map(F.lit, KINDS)), s.kind), s.start, s.stop)), ",")


def digests(found: DataFrame) -> DataFrame:
    """Counts of the base spans by kind, the hash of their list, and the list of all spans."""
    counts = [F.aggregate("base", F.lit(0).cast("long"), _adder(k)).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_text_of("base"), 256).alias("base_sha256"), _text_of("all").alias("spans"))


def _adder(k: int):
    return lambda n, s: n + F.when(s.kind == k, 1).otherwise(0)


def _redacted(text: str, taken: list[Span]) -> str:
    out, at = [], 0
    for a, k, b in taken:
        if a >= at:
            out += [text[at:a], f"<{KINDS[k]}>"]
        at = max(at, b)
    return "".join(out) + text[at:] if out else text


def _redactor(added: str):
    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Replaces base spans and the spans of the column ``added``."""
        for batch in batches:
            extra = batch.column(added).to_pylist()
            texts = batch.column("text").to_pylist()
            new = [None if t is None else _redacted(t, sorted([*base_spans(t), *((s["start"], s["kind"], s["stop"]) for s in x or ())])) for t, x in zip(texts, extra, strict=True)]
            rest = batch.drop_columns([added])
            yield rest.set_column(rest.schema.get_field_index("text"), "text", pa.array(new, pa.string()))
    return redact


def redact(docs: DataFrame) -> DataFrame:
    """The documents with each span replaced by its kind in angle brackets, with the columns they came with.

    Added spans depend on the text alone, so they are found again by its hash; where the corpus has none, no join is made.
    """
    _, known = find(docs)
    added, digest = spare(docs, "_added"), spare(docs, "_digest")
    if known is None:
        full = docs.withColumn(added, F.lit(None).cast("array<struct<start:int,kind:int,stop:int>>"))
    else:
        texts = docs.select("text").mapInArrow(_with_likes, "digest string, kind int, value string, start int, stop int")
        extra = (texts.join(known, ["kind", "value"], "left_semi").dropDuplicates(["digest", "start"])
                 .groupBy("digest").agg(F.collect_list(F.struct("start", "kind", "stop")).alias(added)).withColumnRenamed("digest", digest))
        full = docs.withColumn(digest, F.sha1("text")).join(extra, digest, "left").drop(digest)
    return full.select(*[F.col(f"`{c}`") for c in docs.columns], added).mapInArrow(_redactor(added), docs.schema)


def _with_likes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            if text and (likes := like_spans(text, base_spans(text))):
                digest = hashlib.sha1(text.encode()).hexdigest()
                rows += [(digest, s[1], _value(text, s), s[0], s[2]) for s in likes]
        cols = list(zip(*rows)) or [()] * 5
        yield pa.record_batch([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.int32())],
                              ["digest", "kind", "value", "start", "stop"])
