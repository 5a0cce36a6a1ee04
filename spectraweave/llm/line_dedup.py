"""Near-duplicate lines by a segment-partition edit join, with SQL functions only.

A line within `distance` edits of another must share, unchanged, one of that
one's distance + 1 segments, at a place that the segment's number bounds. So each
distinct line is indexed by its segments (keyed by class of lengths, number and
text) and probes the indexes of its own class, and of the class below if it is
within `distance` of it. What meets is verified with the banded bit-parallel edit
distance.

The distance can differ by bands of lengths, and count words instead of
characters: a long line with one word replaced is many characters away, but one
word.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, rewritten, shared_folder, unused

DISTANCE, MIN_CHARS = 2, 40
#: (unit, least and greatest length of the shorter line in it, edits): of the least length in words a twentieth may differ.
WORD_BANDS = [("words", 20, 39, 1), ("words", 40, 79, 2), ("words", 80, 159, 4), ("words", 160, None, 8)]
#: What the query and the pipeline's stage take: equal lines of any length, and one edit in twenty characters at most in short lines.
WHOLE = {"min_chars": 1, "bands": [("chars", 20, MIN_CHARS - 1, 1), ("chars", MIN_CHARS, None, DISTANCE), *WORD_BANDS]}
#: Most bytes of a table that is broadcast; larger ones are shuffled.
BROADCAST_BYTES = 16_000_000
_LETTERS = "etaoinsrhldu"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once: an array of one element names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def edit_distance_within(a: Column, b: Column, k: int) -> Column:
    """Whether a and b are within k edits, for length(a) >= length(b) >= 2 k + 2 and lengths at most k apart.

    Column j of the dynamic-programming matrix is held only in the band of rows
    j - k .. j + k, as one bit a row of each sign of the vertical differences.
    The band's lowest row is followed down the diagonal until the last row is
    reached, and then along that row to its end, which is the distance.
    """
    a, b = _differing(a, b, 2 * k + 2)
    chars = F.struct(*[F.regexp_extract_all(x, F.lit("(?s)."), F.lit(0)).alias(n) for x, n in ((b, "text"), (a, "pattern"))])
    # an array of one element names the characters, so that they are split once
    return F.get(F.transform(F.array(chars), lambda x: _within(x["text"], x["pattern"], k)), F.lit(0))


def _differing(a: Column, b: Column, least: int) -> tuple[Column, Column]:
    """a and b without what they share at both ends, but with at least `least` characters of the shorter b left.

    The shared lengths are found by halving steps, on whole substrings.
    """
    steps = F.array(*[F.lit(1 << n) for n in range(22, -1, -1)])
    room = F.length(b) - least

    def shared(end: str, most: Column) -> Column:
        part = lambda x, n: F.substring(x, F.lit(1), n) if end == "start" else F.substring(x, F.length(x) - n + 1, n)
        return F.aggregate(steps, F.lit(0), lambda s, n: F.when(s + n > most, s).when(part(a, s + n) == part(b, s + n), s + n).otherwise(s))

    head = shared("start", room)
    ends = F.get(F.transform(F.array(head), lambda h: F.struct(h.alias("head"), shared("end", room - h).alias("tail"))), F.lit(0))
    cut = lambda e: F.struct(*[F.substring(x, e["head"] + 1, F.length(x) - e["head"] - e["tail"]).alias(n) for n, x in (("a", a), ("b", b))])
    both = F.get(F.transform(F.array(ends), cut), F.lit(0))
    return both["a"], both["b"]


def _within(text: Column, pattern: Column, k: int) -> Column:
    width = 2 * k + 1
    ones = (1 << width) - 1
    rows = F.size(pattern)

    def matches(j: Column) -> Column:
        """Bit r: whether row j - k + r of the pattern is the text's character j; most are met once or not at all in the band."""
        char = F.get(text, j)
        band = F.slice(pattern, F.greatest(j - k, F.lit(0)) + 1, F.least(F.lit(width), j + k + 1))
        skipped = F.greatest(k - j, F.lit(0))

        def bits(b: Column) -> Column:
            every = F.aggregate(F.reverse(b), F.lit(0), lambda m, x: m * 2 + F.when(x == char, 1).otherwise(0))
            at = F.array_position(b, char).cast("int")
            again = F.array_contains(F.slice(b, at + 1, F.lit(width)), char)
            return F.when(at == 0, 0).when(again, every).otherwise(F.call_function("shiftleft", F.lit(1), at - 1))

        return F.call_function("shiftleft", _let(band, bits), skipped)

    def step(s: Column, j: Column) -> Column:
        return _let(matches(j), lambda m: _let(diagonal(s, m), lambda d0: after(s, d0, j)))

    def diagonal(s: Column, match: Column) -> Column:
        d0 = match.bitwiseAND(s["vp"]) + s["vp"]
        return d0.bitwiseXOR(s["vp"]).bitwiseOR(match).bitwiseOR(s["vn"]).bitwiseAND(F.lit(ones))

    def after(t: Column, d0: Column, j: Column) -> Column:
        vp, vn = t["vp"], t["vn"]
        hp = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp)).bitwiseAND(F.lit(ones)))
        hn = d0.bitwiseAND(vp)
        down = F.shiftright(d0, 1)
        past = j - (rows - k)  # how far the band's lowest row is past the last row
        bit = F.greatest(F.lit(0), width - 2 - past)
        along = F.getbit(hp, bit).cast("int") - F.getbit(hn, bit).cast("int")
        d = t["d"] + F.when(past < 0, 1 - F.shiftright(d0, width - 1)).otherwise(along)
        new_vp = hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(hp)).bitwiseAND(F.lit(ones)))
        return F.struct(new_vp.alias("vp"), down.bitwiseAND(hp).alias("vn"), d.alias("d"))

    start = F.struct(F.lit(ones & ~((1 << k) - 1)).alias("vp"), F.lit(0).alias("vn"), F.lit(k).alias("d"))
    return F.aggregate(F.sequence(F.lit(0), F.size(text) - 1), start, step, lambda s: s["d"] <= k)


def _places(k: int) -> list[tuple[int, bool, int, int]]:
    """(segment, whether counted from the end, segments from there, shift) of the places where a segment can be met.

    Let i be the first of k + 1 segments that ends with no more than i edits up
    to there: it is intact, i edits are before it and k - i after it at most. So
    it is met within i places of where it is from the start, and within k - i of
    where it is from the end: segments of the first half are placed from the
    start, the others from the end, whatever the other line's length.
    """
    out = []
    for i in range(k + 1):
        first = 2 * i <= k
        reach = i if first else k - i
        out += [(i, not first, i if first else k + 1 - i, shift) for shift in range(-reach, reach + 1)]
    return out


Band = tuple[str, int, int | None, int]


def _width(least: int, k: int) -> int:
    """The width of a band's first two classes of lengths; each next pair is twice as wide."""
    return 1 << max(k - 1, -(-least // 4) - 1, 0).bit_length()


def _class(n: Column, bands: list[tuple[int, Band]]) -> Column:
    """(band, k, start): the class of lengths that a length is in; its segments are as long as those of its least length, `start`."""
    out = F.lit(None)
    for number, (_, least, greatest, k) in reversed(bands):
        x = n - least + 2 * _width(least, k)
        step = F.call_function("shiftleft", F.lit(1), F.length(F.bin(x)) - 2)
        inside = n.between(least, greatest) if greatest else n >= least
        out = F.when(inside, F.struct(F.lit(number).alias("band"), F.lit(k).alias("k"), (n - x % step).cast("int").alias("start"))).otherwise(out)
    return out


def _top(m: Column, bands: list[tuple[int, Band]]) -> Column:
    """The largest length up to m that is in a band."""
    out = F.lit(None).cast("int")
    for _, (_, least, greatest, _) in bands:
        out = F.when(m >= least, F.least(m, F.lit(greatest)) if greatest else m).otherwise(out)
    return out


def _below(bands: list[tuple[int, Band]]) -> int:
    """How many classes below its own a line can have a partner in, at most."""
    edges, most = [], 0
    for _, (_, least, greatest, k) in bands:
        at, last = least, greatest or 16 * (least + k)
        while at <= last:
            x = at - least + 2 * _width(least, k)
            edges.append((at, k))
            at += (1 << (x.bit_length() - 2)) - x % (1 << (x.bit_length() - 2))
    for i, (start, _) in enumerate(edges):
        most = max(most, sum(edges[j + 1][0] - 1 >= start - k for j, (_, k) in enumerate(edges[:i])))
    return max(1, most)


def _segments(lines: DataFrame, bands: list[tuple[int, Band]]) -> DataFrame:
    """(h, seg, meta) of lines (h, norm, n, and words for bands of words): the hashed segments of one unit's bands.

    A line has its own segments, in the class of its length; and what may be a
    segment of a line of its class, or of one up to k shorter in the class
    below, is a probe. meta: twice the band's number, and 1 for an own segment.
    """
    part = F.slice if bands[0][1][0] == "words" else F.substring
    text = "words" if bands[0][1][0] == "words" else "norm"
    rows, names = lines.withColumn("c0", _class(F.col("n"), bands)), ["c0"]
    upto = F.coalesce(F.col("c0.start") - 1, F.col("n") - 1)
    for i in range(1, _below(bands) + 1):
        rows = rows.withColumn(f"t{i}", _top(upto, bands)).withColumn(f"c{i}", _class(F.col(f"t{i}"), bands))
        rows = rows.withColumn(f"c{i}", F.when(F.col(f"t{i}") >= F.col("n") - F.col(f"c{i}.k"), F.col(f"c{i}")))
        names, upto = [*names, f"c{i}"], F.col(f"c{i}.start") - 1
    rows = rows.select("h", text, "n", F.explode(F.array(*names)).alias("c"), (F.col("c0.start")).alias("own_start")).where("c is not null")
    places = F.lit(None)
    for k in {k for _, (*_, k) in bands}:
        listed = F.array(*[F.struct(*[F.lit(v).alias(x) for x, v in zip(("i", "end", "j", "shift"), p)]) for p in _places(k)])
        places = F.when(F.col("c.k") == k, listed).otherwise(places)
    rows = rows.select("h", text, "n", "c", "own_start", F.explode(places).alias("p"))
    size = F.floor(F.col("c.start") / (F.col("c.k") + 1)).cast("int")
    start = F.when(F.col("p.end"), F.col("n") - F.col("p.j") * size).otherwise(F.col("p.j") * size) + F.col("p.shift") + 1
    own = (F.col("p.shift") == 0) & F.coalesce(F.col("own_start") == F.col("c.start"), F.lit(False))
    seg = F.xxhash64(F.col("c.band"), F.col("c.start"), F.col("p.i"), part(F.col(text), start, size))
    return rows.select("h", seg.alias("seg"), (F.col("c.band") * 2 + own.cast("int")).cast("byte").alias("meta"))


def _counts(norm: Column, n: Column) -> Column:
    """Length and counts of some letters, each modulo 16, in 4 bits each."""
    out = (n % 16).cast("long")
    for c in _LETTERS:
        out = out * 16 + (n - F.length(F.replace(norm, F.lit(c), F.lit("")))) % 16
    return out


def _parities(words: Column, low: int, part: int | None = None) -> Column:
    """Bit h: whether the words of hash h are odd in number; the hash: six bits from `low`, of words whose next bit is `part`, if given."""
    hashes = F.transform(words, lambda w: F.call_function("shiftright", F.xxhash64(w), F.lit(low)).bitwiseAND(F.lit(127)).cast("int"))
    # a shift takes the lowest six bits of its count
    one = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h)
    mine = (lambda h: one(h)) if part is None else lambda h: F.when(h.between(64 * part, 64 * part + 63), one(h)).otherwise(0)
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda s, h: s.bitwiseXOR(mine(h)))


def _apart(a: Column, b: Column, k: Column) -> Column:
    """Whether two lines' counts are further apart than k edits can make them.

    An edit changes the length by one and two counts by one, at most;
    differences are taken round the circle of 16, and so never too large. All
    13 differences are worked out at once, in 4 bits each.
    """
    every = (1 << 4 * len(_LETTERS) + 4) - 1
    signs, rest = F.lit(0x8888888888888888 & every), F.lit(0x7777777777777777 & every)
    right = lambda x, n: F.shiftrightunsigned(x, n)
    gap = (a.bitwiseOR(signs) - b.bitwiseAND(rest)).bitwiseXOR(a.bitwiseXOR(b).bitwiseXOR(F.lit(every)).bitwiseAND(signs))
    minus = right(gap.bitwiseAND(signs), 3)
    size = gap.bitwiseXOR(minus * 15) + minus
    total = size.bitwiseAND(F.lit(0x0F0F0F0F0F0F)) + right(size, 4).bitwiseAND(F.lit(0x0F0F0F0F0F0F))
    total = total.bitwiseAND(F.lit(0x00FF00FF00FF)) + right(total, 8).bitwiseAND(F.lit(0x00FF00FF00FF))
    total = (total + right(total, 16) + right(total, 32)).bitwiseAND(F.lit(0xFFFF))
    return (right(size, 4 * len(_LETTERS)) > k) | (total > 2 * k)


def _lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    text = F.col(text_col).cast("string")
    # the text is hashed here, as below it would be for each of its lines
    tagged = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("tag"), text.alias("text"))
    rows = tagged.select("id", "tag", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    rows = rows.where(F.length("line") >= min_chars).select("id", "tag", "pos", F.lower(F.trim("line")).alias("norm"))
    return rows.where(F.length("norm") >= min_chars).select(F.xxhash64("norm").alias("h"), F.struct("id", "tag", "pos").alias("at"), "norm")


def _met(small: DataFrame, size: Column | None = None) -> DataFrame:
    """small, a written copy, to be broadcast if its rows of `size` bytes (a few numbers, if not given) are few enough."""
    total = small.agg(F.coalesce(F.sum(F.lit(64) if size is None else size), F.lit(0))).first()[0]
    return F.broadcast(small) if total <= BROADCAST_BYTES else small


def _words(norm: Column) -> Column:
    return F.split(norm, " ", -1)


def _verified(pairs: DataFrame, texts: DataFrame, bands: list[Band]) -> DataFrame:
    """Those h of pairs (h, h2, band), a written copy, that are within the band's distance of an h2."""
    mine = texts.select("h", "norm").join(_met(pairs, F.lit(32)), "h")
    yours = texts.select(F.col("h").alias("h2"), F.col("norm").alias("norm2")).join(_met(checkpointed(pairs.select("h2").distinct()), F.lit(16)), "h2")
    both = mine.join(yours, "h2")
    found = None
    for unit in dict.fromkeys(unit for unit, *_ in bands):
        length = F.length if unit == "chars" else lambda x: F.size(_words(x))
        sized = F.struct(*[x.alias(n) for n, x in (("a", F.col("norm")), ("b", F.col("norm2")), ("n", length(F.col("norm"))), ("m", length(F.col("norm2"))))])
        swap = lambda x: F.struct(x["b"].alias("a"), x["a"].alias("b"), x["m"].alias("n"), x["n"].alias("m"))
        ordered = _let(sized, lambda x: F.when(x["n"] >= x["m"], x).otherwise(swap(x)))

        def verdict(x: Column) -> Column:
            out = F.lit(False)
            for number, (kind, _, _, k) in enumerate(bands):
                if kind == unit:  # noqa: B023
                    within = edit_distance_within(x["a"], x["b"], k) if unit == "chars" else _words_within(x["a"], x["b"], k)
                    out = F.when(F.col("band") == number, F.when(x["n"] - x["m"] <= k, within).otherwise(False)).otherwise(out)
            return out

        mine = both.where(F.col("band").isin([b for b, (u, *_) in enumerate(bands) if u == unit]))
        part = mine.where(_let(ordered, verdict)).select("h")
        found = part if found is None else found.unionByName(part)
    return found.distinct()


def near_earlier(distinct: DataFrame, bands: list[Band]) -> DataFrame:
    """The h of distinct lines (h, n, norm, first) that are within the distance of a line whose `first` is earlier.

    The distance is that of the shorter line's band, of any band of either unit;
    bands of a unit are in order, apart, and of at least 2 * distance + 2 units.

    Most segments are met by no other line: those are dropped where the segments
    are first brought together. A line is first compared with the earliest line
    that has a segment in each place where it meets others, which settles most
    lines of a large group; only the lines that this leaves open are compared
    with all earlier lines that they meet.
    """
    numbered = list(enumerate(bands))
    of = lambda unit: [x for x in numbered if x[1][0] == unit]
    rows = _segments(distinct.select("h", "norm", "n"), of("chars")) if of("chars") else None
    if of("words"):
        least = min(b[1] for _, b in of("words"))
        long = distinct.where(F.col("n") >= 2 * least - 1).select("h", _words(F.col("norm")).alias("words"))
        mine = _segments(long.withColumn("n", F.size("words")).where(F.col("n") >= least), of("words"))
        rows = mine if rows is None else rows.unionByName(mine)
    # a bucket counts if it holds a line's own segment and another line
    bucket = Window.partitionBy("seg")
    some, lines = F.max(F.col("meta") % 2).over(bucket) == 1, F.min("h").over(bucket) != F.max("h").over(bucket)
    # a line whose words repeat has one segment at several places; it counts once
    shared = rows.withColumn("__met", some & lines).where("__met").groupBy("seg", "h").agg(F.max("meta").alias("meta"))
    shared = checkpointed(shared.select("h", "seg", "meta", (F.count("*").over(bucket) > 2).alias("many")))
    ids = checkpointed(shared.select("h").distinct())
    words = _words(F.col("norm")) if of("words") else F.array().cast("array<string>")
    signs = [F.size(words).alias("n_words"), _counts(F.col("norm"), F.col("n")).alias("chars"), _parities(words, 0).alias("odd0"), _parities(words, 7, 0).alias("odd1"), _parities(words, 7, 1).alias("odd2")]
    texts = checkpointed(distinct.join(_met(ids), "h").select("h", "norm", "first", "n", *signs))
    in_words = F.get(F.array(*[F.lit(unit == "words") for unit, *_ in bands]), F.col("band"))
    pick = lambda a, b: F.when(in_words, F.col(a)).otherwise(F.col(b) if isinstance(b, str) else F.lit(b))
    sign = F.struct(pick("n_words", "n").alias("n"), pick("odd0", "chars").alias("a"), pick("odd1", 0).alias("b"), pick("odd2", 0).alias("c"))
    counted = shared.join(_met(texts.drop("norm"), F.lit(112)), "h").withColumn("band", F.floor(F.col("meta") / 2).cast("int"))
    counted = checkpointed(counted.select("h", "seg", "band", (F.col("meta") % 2 == 1).alias("own"), "many", "first", sign.alias("sign")))
    k = F.get(F.array(*[F.lit(k) for *_, k in bands]), F.col("band"))
    # an edit changes the parity of two words at most
    a, b, c = (F.bit_count(F.col(f"sign.{x}").bitwiseXOR(F.col(f"sign2.{x}"))) for x in "abc")
    odd = F.greatest(a, b + c)
    apart = F.when(in_words, odd > 2 * k).otherwise(_apart(F.col("sign.a"), F.col("sign2.a"), k))
    close = (F.abs(F.col("sign.n") - F.col("sign2.n")) <= k) & ~apart
    earlier = F.col("first") > F.col("first2")
    lead = counted.groupBy("seg").agg(F.min(F.struct("first", "h", "own", "sign")).alias("l"))
    lead = lead.select("seg", F.col("l.h").alias("h2"), F.col("l.own").alias("own2"), F.col("l.first").alias("first2"), F.col("l.sign").alias("sign2"))
    led = checkpointed(counted.join(lead, "seg").where((F.col("own") | F.col("own2")) & earlier & close).select("h", "h2", "band").distinct())
    settled = checkpointed(_verified(led, texts, bands))
    # where two lines meet, that was all
    more = counted.where("many")
    left = checkpointed(more.join(_met(settled), "h", "left_anti"))
    more = more.join(_met(checkpointed(left.select("seg").distinct())), "seg", "left_semi")
    near = _met_once(left, more, lambda df: df.where(earlier & close))
    return settled.unionByName(_verified(checkpointed(near.join(led, ["h", "h2", "band"], "left_anti")), texts, bands))


def _met_once(left: DataFrame, more: DataFrame, kept: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(h, h2, band): the pairs of a line of left and one of more that have a segment in common, which one of them has as its own, each once.

    left and more(h, seg, band, own, first, sign) hold a line's segment once, and
    more has all of left. kept leaves out pairs by first, sign and band. Lines that
    are near, or end in the same words, meet in many segments: a pair is made in
    the smallest of them only.
    """
    lists = more.groupBy("h", "band").agg(F.collect_list("seg").alias("every"), F.collect_list(F.when(F.col("own"), F.col("seg"))).alias("owned"))
    lists = checkpointed(lists)
    # rows of one line, of at most all its segments
    left, more = (df.join(lists, ["h", "band"]) for df in (left, more))
    other = more.select("seg", *[F.col(c).alias(f"{c}2") for c in ("h", "own", "first", "sign", "every", "owned")])
    common = F.concat(F.array_intersect("every", "owned2"), F.array_intersect("owned", "every2"))
    least = F.col("seg") == F.array_min(common)
    pairs = lambda mine, yours: kept(mine.join(yours, "seg")).where(least).select("h", "h2", "band")
    return pairs(left.where("own"), other.where("not own2")).unionByName(pairs(left, other.where("own2")))


def _words_within(a: Column, b: Column, k: int) -> Column:
    """edit_distance_within, with words for characters and for any number of them.

    What both share at their ends is left out, in whole words, and words that
    both have are put at the end, so that neither is too short for the band.
    """
    steps = F.array(*[F.lit(1 << n) for n in range(22, -1, -1)])

    def shared(part: Callable[[Column, Column], Column], most: Column) -> Column:
        return F.aggregate(steps, F.lit(0), lambda s, n: F.when(s + n > most, s).when(part(a, s + n) == part(b, s + n), s + n).otherwise(s))

    start = lambda x, n: F.substring(x, F.lit(1), n)
    end = lambda x, n: F.substring(x, F.length(x) - n + 1, n)
    least = F.least(F.length(a), F.length(b))
    head = _let(shared(start, least), lambda n: n - F.length(F.substring_index(start(a, n), " ", -1)))
    tail = lambda h: _let(shared(end, least - h), lambda n: n - F.length(F.substring_index(end(a, n), " ", 1)))
    same = F.array_repeat(F.lit(" "), 2 * k + 2)
    rest = lambda x, h, t: F.concat(_words(F.substring(x, h + 1, F.length(x) - h - t)), same)
    words = lambda h: _let(tail(h), lambda t: F.struct(rest(b, h, t).alias("text"), rest(a, h, t).alias("pattern")))
    # what differs may be few enough words to be replaced one by one
    return _let(_let(head, words), lambda x: (F.size(x["pattern"]) <= 3 * k + 2) | _within(x["text"], x["pattern"], k))


def repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, min_chars: int = MIN_CHARS, bands: list[tuple[str, int, int | None, int]] | None = None
) -> DataFrame:
    """(id, tag, removed): for each document with some, the places (from 0) of its lines that an earlier line is near to.

    tag is the hash of the text. Lines come in the order of document id (null
    first), tag and place; a line is near another if, trimmed and in lower case,
    they are within `distance` edits. Lines of under `min_chars` characters take
    no part. Lines are told apart by a 64-bit hash. bands, if given, takes the
    place of the one distance: lines outside of all of them only go if equal.
    """
    bands = bands or [("chars", min_chars, None, distance)]
    if any(least < 2 * k + 2 for _, least, _, k in bands):
        raise ValueError("a band's least length must be at least 2 * distance + 2")
    lines = _lines(docs, id_col, text_col, min_chars)
    grouped = lines.groupBy("h").agg(F.first("norm").alias("norm"), F.min("at").alias("first"), F.max("at").alias("last"))
    distinct = rewritten(grouped.withColumn("n", F.length("norm")), shared_folder(docs.sparkSession), f"lines-{uuid.uuid4().hex}", compression="zstd")
    near = checkpointed(near_earlier(distinct, bands))
    # a line near to an earlier one goes wherever it stands, any other but for its first place
    ends = distinct.select("h", "first", "last").join(_met(near).withColumn("near", F.lit(True)), "h", "left").where("near or last > first")
    cuts = checkpointed(ends.select("h", F.when(F.col("near").isNull(), F.col("first")).alias("first")))
    removed = lines.select("h", "at").join(_met(cuts), "h").where("first is null or at > first")
    return removed.groupBy("at.id", "at.tag").agg(F.collect_set("at.pos").alias("removed"))


def deduplicated(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, min_chars: int = MIN_CHARS, removed_col: str | None = None,
    bands: list[tuple[str, int, int | None, int]] | None = None,
) -> DataFrame:
    """docs with the lines that an earlier line is near to taken out of its texts, all other columns as they are.

    The first line of each kind stays, so no line is lost altogether; rows are
    never dropped, and a text may become empty. removed_col, if given, names a
    new column with the places of the lines taken out. Null texts stay null.
    Equal rows are one document and keep equal texts. An empty table gives none.
    A column of docs may have any name but removed_col, whose place it would take.
    """
    found = checkpointed(repeated_lines(docs, id_col, text_col, distance, min_chars, bands))
    text = F.col(text_col).cast("string")
    of, tag, gone = (unused(docs, n) for n in ("__id", "__tag", "__removed"))
    mine = _met(found.select(F.col("id").alias(of), F.col("tag").alias(tag), F.col("removed").alias(gone)), 64 + 4 * F.size(gone))
    joined = docs.join(mine, F.col(id_col).eqNullSafe(F.col(of)) & (F.xxhash64(text) == F.col(tag)), "left")
    lines = F.split(text, "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    # an array of one element names the lines, so that they are split once
    rest = F.get(F.transform(F.array(lines), lambda x: F.transform(kept, lambda i: F.get(x, i))), F.lit(0))
    out = {c: F.col(c) for c in docs.columns} | {text_col: F.when(F.col(gone).isNull(), text).otherwise(F.array_join(rest, "\n"))}
    if removed_col:
        out[removed_col] = F.coalesce(F.array_sort(gone), F.array().cast("array<int>"))
    return joined.select(*[x.alias(c) for c, x in out.items()])
