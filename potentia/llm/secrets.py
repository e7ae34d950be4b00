"""Op 4: secrets in texts, with a guess-cost estimate for values in credential contexts.

Base spans are assignments of long values to credential names, access key ids and long hex runs. The
method looks at every value that a credential name introduces, those in assignment spans too, and works out how
many guesses the cheapest segmentation of the value needs: dynamic programming over words, dates, repeats,
keyboard walks and brute-force characters. A value that needs `least_log10` guesses or more is a `guess`
span; cheaper ones ("password: changeme") are counted as weak. Nothing but the cost decides.

Words are ranked: first those that guessers try first (WORDS), then the `dictionary_words` words that stand in most
documents of the corpus (or fewer: all that stand in at least so many), counted over all of them; the parameter bounds the
guesser's dictionary, not the scan. Values in
credential contexts are left out of that count, so that a secret in many copies doesn't become a word.

The scan is one pass over the texts in Arrow batches; a text without any of the names or runs is passed by with byte
searches. Positions are code points, ends exclusive.

Defined cases: a null or empty text has no spans; rows that repeat are each reported; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "guess")

#: Names that introduce a credential, and what may stand between a name and its value.
CONTEXT = re.compile(r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth)[a-z_]{0,12}["']?[ \t]*(?:[:=]{1,2}>?|->|\bis\b)[ \t]*["'`]?([^\s"'`,;<>(){}\[\]]{8,})""", re.I | re.A)
_NAMES = (b"pass", b"pwd", b"secret", b"token", b"key", b"credential", b"auth")

#: Words that guessers try first, in the order in which they try them.
WORDS = """password qwerty admin welcome login secret test letmein master dragon monkey shadow sunshine princess football
baseball hello freedom whatever trustno michael jordan superman batman starwars summer winter spring autumn monday friday
january february march april june july august september october november december love money computer internet server root
user guest default changeme example sample demo public private access system service database account token key api dev
prod staging backup office company google amazon apple windows linux oracle mysql pass word my the your this is not none
null true false here value string insert replace enter placeholder foo bar baz abc temp temporary dummy fake""".split()
_RANK = {w: i + 1 for i, w in enumerate(WORDS)}
LONGEST_WORD = 24
_LEET = str.maketrans("4@31!0$57+", "aaeiiosstt")
_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
_NEXT = {(a, b) for r in _ROWS for x in (r, r[::-1]) for a, b in zip(x, x[1:])} | {(a, b) for r1, r2 in zip(_ROWS[1:], _ROWS[2:]) for x, y in zip(r1, r2) for a, b in ((x, y), (y, x))}
_DATES = [re.compile(p, re.A) for p in (r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])", r"(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d", r"(?:19|20)\d\d")]


def _alphabet(c: str) -> int:
    return 10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33 if c.isascii() else 100


def word_log10(rank: int, written: str, low: str, plain: str) -> float:
    """A word: its rank, doubled for other than lower case and for each letter written as a digit or sign."""
    return math.log10(rank * (1 + (written != low)) * 2 ** sum(x != y for x, y in zip(low, plain)) + 1)


def repeat_log10(first: str, length: int, steady: bool) -> float:
    """A run of one character, or (steady) of an ascending or descending sequence: its alphabet times its length."""
    return math.log10(_alphabet(first) * length * (1 + steady))


def walk_log10(length: int) -> float:
    """A keyboard walk of three keys or more: its start, its length, and two ways to go at each key."""
    return math.log10(47 * length) + 0.3 * (length - 1)


def date_log10(length: int) -> float:
    """A date: 100 years of days, or of years alone."""
    return math.log10(36525 if length > 4 else 150)


def folded(value: str) -> tuple[str, str]:
    """value in lower case, and with digits and signs that stand for letters as these."""
    low = value.lower()
    return (low, low.translate(_LEET)) if len(low) == len(value) else (value, value)  # some capitals have longer lower-case forms


class _Run:
    """Where a run that ends here may have begun, at least cost. A start that an earlier one has beaten stays beaten, since the
    earlier one's length counts for ever less, so it is dropped; in a run of n characters nearly all starts are."""

    def __init__(self):
        self.begin, self.starts = 0, []

    def grow(self, goes_on: bool, i: int, best: list[float], cost) -> float:
        if not goes_on:
            self.begin, self.starts = i - 1, []
            return math.inf
        if i - self.begin < 3:
            return math.inf
        self.starts.append(i - 3)
        costs = [best[s] + cost(s, i - s) for s in self.starts]
        least = min(costs)
        del self.starts[costs.index(least) + 1 :]
        return least


def guess_cost(value: str, ranks: dict[str, int] = _RANK, enough: float = math.inf) -> float:
    """log10 of the guesses for the cheapest segmentation of value: the least sum of its segments' costs.

    Segments are words, dates, runs of at least three characters (equal, or each one above or one below the last), keyboard
    walks of at least three keys, and single characters, which cost their alphabet. The work grows linearly with the length. Once
    every way to go on costs `enough`, that bound is returned.
    """
    n = len(value)
    low, plain = folded(value)
    best = [0.0] + [math.inf] * n
    same, steady, walk, delta = _Run(), _Run(), _Run(), 0
    dates: dict[int, list[int]] = {}
    for i in range(n):
        if value[i].isdigit():
            for pattern in _DATES:
                if m := pattern.match(value, i):
                    dates.setdefault(m.end(), []).append(i)
    for i in range(1, n + 1):
        b = value[i - 1]
        cost = best[i - 1] + math.log10(_alphabet(b))
        if i > 1:
            a = value[i - 2]
            step = ord(b) - ord(a)
            cost = min(cost, same.grow(a == b, i, best, lambda s, k: repeat_log10(value[s], k, False)))
            up = abs(step) == 1 and a.isalnum() and b.isalnum()
            if up and step != delta and i > 2 and steady.begin != i - 2:
                steady.begin, steady.starts = i - 2, []  # the direction turned: a run may begin at a
            cost = min(cost, steady.grow(up, i, best, lambda s, k: repeat_log10(value[s], k, True)))
            cost = min(cost, walk.grow((low[i - 2], low[i - 1]) in _NEXT, i, best, lambda s, k: walk_log10(k)))
            delta = step
        for j in range(max(0, i - LONGEST_WORD), i - 2):
            rank = ranks.get(plain[j:i])
            if rank:
                cost = min(cost, best[j] + word_log10(rank, value[j:i], low[j:i], plain[j:i]))
        for j in dates.get(i, ()):
            cost = min(cost, best[j] + date_log10(i - j))
        best[i] = cost
        if not i % 64:
            reach = min(i - 2 * LONGEST_WORD, same.begin, walk.begin, steady.begin)
            if reach >= 0 and (least := min(best[reach : i + 1])) >= enough:
                return least
    return best[n]


def find_spans(text: str, least_log10: float, ranks: dict[str, int] = _RANK) -> tuple[list[tuple[int, int, int]], int]:
    """(start, kind, end), kinds by their place in KINDS, sorted; and how many values are weak."""
    if not text:
        return [], 0
    raw = text.encode("utf-8", "surrogatepass")
    low = raw.lower()
    spans: list[tuple[int, int, int]] = []
    weak = 0
    named = any(x in low for x in _NAMES)
    if named:
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if b"AKIA" in raw:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if b"x" * 16 in raw.translate(_HEX_ONLY):
        spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 16]
    if named:
        for m in CONTEXT.finditer(text):
            value = m.group(1).rstrip(".:!?")
            if guess_cost(value, ranks, least_log10) >= least_log10:
                spans.append((m.start(1), 3, m.start(1) + len(value)))
            else:
                weak += 1
    return sorted(spans), weak


_HEX_ONLY = bytes(ord("x") if chr(b) in "0123456789abcdef" else 32 for b in range(256))


def common_words(docs: DataFrame, dictionary_words: int) -> list[str]:
    """The words (3 to LONGEST_WORD letters, in lower case) that stand in most documents, in that order; values in credential contexts aside."""
    named = F.regexp_like("text", F.lit("(?i)" + "|".join(x.decode() for x in _NAMES)))
    prose = F.when(named, F.regexp_replace("text", "(?i)" + CONTEXT.pattern, " ")).otherwise(F.col("text"))
    own = F.array_distinct(F.regexp_extract_all(F.lower(prose), F.lit(rf"\p{{L}}{{3,{LONGEST_WORD}}}"), F.lit(0)))
    counts = docs.where("text is not null").select(F.explode(own).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    counts = cut(counts.where("n > 1").withColumn("octave", F.floor(F.log2("n") * 8)))
    # the least number of documents (in eighths of octaves) that no more words reach, so that only these come to the driver
    least, words = math.inf, 0
    for r in counts.groupBy("octave").agg(F.count("*").alias("words")).orderBy(F.desc("octave")).collect():
        words += r.words
        if words > dictionary_words:
            break
        least = r.octave
    return [r.word for r in sorted(counts.where(F.col("octave") >= least).collect(), key=lambda r: (-r.n, r.word))]


def scan(docs: DataFrame, *, least_log10: float = 12.0, dictionary_words: int = 20_000) -> DataFrame:
    """For each document: spans array<struct<kind, start, end>>, by start and then kind; n_weak, its credential values of fewer guesses."""
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    ranks = {w: i + 1 for i, w in enumerate(dict.fromkeys([*WORDS, *common_words(docs, dictionary_words)]))}

    def run(batches):
        for batch in batches:
            spans, weak = zip(*[find_spans(t.as_py(), least_log10, ranks) for t in batch.column(1)]) if batch.num_rows else ((), ())
            named = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in own] for own in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(named, kinds), pa.array(weak, pa.int64())], names=["doc_id", "spans", "n_weak"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: long, end: long>>, n_weak long")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts, checksum and text form of the spans."""
    joined = lambda where: F.expr(f"array_join(transform(filter(spans, x -> {where}), x -> concat(x.kind, ':', x.start, ':', x.end)), ',')")
    count = lambda kind: F.expr(f"cast(size(filter(spans, x -> x.kind = '{kind}')) as bigint)").alias(f"n_{kind}")
    return scanned.select("doc_id", *map(count, KINDS), "n_weak", F.sha2(joined("x.kind <> 'guess'").cast("binary"), 256).alias("base_sha256"), joined("true").alias("spans"))


def redact(text: str, spans: list) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans count as the first."""
    out, at = [], 0
    for x in spans:
        if x["start"] >= at:
            out += [text[at : x["start"]], f"<{x['kind']}>"]
            at = x["end"]
        at = max(at, x["end"])
    return "".join([*out, text[at:]])


def oracle(*, least_log10: float = 12.0, dictionary_words: int = 20_000) -> str:
    """SQL of digest(scan(documents)): every segment of every distinct value is listed with its cost, and a recursion with a step a
    character takes the least sum. For values of some hundred characters at most."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    listed = lambda xs: "[" + ", ".join(map(quoted, xs)) + "]"
    # s and k have one more form each in SQL's caseless patterns; \s there lacks the vertical tab
    plain = lambda x: f"translate({x}, chr(383) || chr(8490), chr(1) || chr(1))"
    context = quoted("(?i)" + CONTEXT.pattern.replace(r"\s", r" \t\n\r\f\v"))
    found = lambda kind, pattern: f"select r, {kind} as kind, regexp_extract_all(t, {pattern}) as whole, regexp_extract_all(t, {pattern}, {'2' if kind == 0 else '1' if kind == 3 else '0'}) as part, string_split_regex(t, {pattern}) as between from texts"
    patterns = (quoted("(?i)" + ASSIGN.pattern), quoted("AKIA[A-Z0-9]{14,}"), quoted("[0-9a-f]{16,}"), context)
    alphabet = lambda c: rf"(case when regexp_full_match({c}, '\p{{Nd}}') then 10 when regexp_full_match({c}, '[A-Za-z]') then 26 when unicode({c}) < 128 then 33 else 100 end)"
    dates = " or ".join(f"regexp_full_match(sub, {quoted(d.pattern)})" for d in _DATES)
    return rf"""
    with recursive docs as (select row_number() over () as r, doc_id, text from documents),
    texts as (select r, {plain("text")} as t from docs where text <> ''),
    raw as ({" union all ".join(found(k, x) for k, x in enumerate(patterns))}),
    places as (
        select r, kind, whole[i] as whole, part[i] as part, list_sum(list_transform(between[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[:i - 1], lambda x: length(x))), 0) as start
        from (select *, unnest(range(1, len(whole) + 1)) as i from raw)),
    base as (
        select r, kind, start, start + length(whole) as stop from places where kind in (1, 2) or (kind = 0 and length(part) >= 12)),
    named as (
        select r, start + length(whole) - length(part) as start, rtrim(substr(text, (start + length(whole) - length(part) + 1)::bigint, length(part)), '.:!?') as v
        from places join docs using (r) where kind = 3),
    prose as (
        select r, case when regexp_matches(text, '(?i){"|".join(x.decode() for x in _NAMES)}') then regexp_replace(text, {context}, ' ', 'g') else text end as t from docs where text is not null),
    words as (
        select word, count(*) as n from (select unnest(list_distinct(regexp_extract_all(lower(t), '\p{{L}}{{3,{LONGEST_WORD}}}'))) as word from prose) group by word having n > 1),
    octaves as (select floor(log2(n) * 8) as octave, count(*) as words from words group by 1),
    least as (select min(octave) as octave from (select octave, sum(words) over (order by octave desc) as reached from octaves) where reached <= {dictionary_words}),
    ordered as (
        select word, row_number() over (order by min(place)) as rank
        from (
            select unnest({listed(WORDS)}) as word, unnest(range({len(WORDS)})) as place
            union all select word, {len(WORDS)} + row_number() over (order by n desc, word) from words where floor(log2(n) * 8) >= (select octave from least))
        group by word),
    vals as (
        select distinct v, case when length(lower(v)) = length(v) then lower(v) else v end as low,
            case when length(lower(v)) = length(v) then translate(lower(v), '4@31!0$57+', 'aaeiiosstt') else v end as folded
        from named),
    steps as (
        select *, list_transform(range(1, length(v)), lambda k: case when regexp_full_match(v[k], '[\p{{L}}\p{{N}}]') and regexp_full_match(v[k + 1], '[\p{{L}}\p{{N}}]') then unicode(v[k + 1]) - unicode(v[k]) else 0 end) as ups,
            list_transform(range(1, length(v)), lambda k: case when list_contains({listed(sorted(a + b for a, b in _NEXT))}, low[k] || low[k + 1]) then 1 else 0 end) as walks
        from vals),
    cuts as (
        select v, j, i, i - j as k, v[j + 1:i] as sub, low[j + 1:i] as low, folded[j + 1:i] as folded, ups[j + 1:i - 1] as ups, walks[j + 1:i - 1] as walks
        from (select *, unnest(range(j + 1, length(v) + 1)) as i from (select *, unnest(range(length(v))) as j from steps))
        where i - j = 1 or i - j >= 3),
    costs as (
        select v, j, i, log10({alphabet("sub")}) as cost from cuts where k = 1
        union all select v, j, i, log10({alphabet("sub[1]")} * k) from cuts where k >= 3 and sub = repeat(sub[1], k)
        union all select v, j, i, log10({alphabet("sub[1]")} * k * 2) from cuts where k >= 3 and list_min(ups) = list_max(ups) and abs(list_min(ups)) = 1
        union all select v, j, i, log10(47 * k) + 0.3::double * (k - 1) from cuts where k >= 3 and list_min(walks) = 1
        union all select v, j, i, log10(case when k > 4 then 36525 else 150 end) from cuts where k >= 4 and ({dates})
        union all select v, j, i, log10(rank * (case when sub <> low then 2 else 1 end) * pow(2, len(list_filter(range(1, k + 1), lambda x: low[x] <> folded[x]))) + 1)
        from cuts join ordered on word = folded where k between 3 and {LONGEST_WORD}),
    cheapest as (select v, j, i, min(cost) as cost from costs group by v, j, i),
    best as (
        select v, 0::bigint as i, [0::double] as sums from vals
        union all
        select b.v, b.i + 1, list_append(any_value(b.sums), min(b.sums[c.j + 1] + c.cost)) from best b join cheapest c on c.v = b.v and c.i = b.i + 1 group by b.v, b.i),
    guessed as (select r, start, start + length(n.v) as stop, sums[-1] >= {least_log10} as hard from named n join best b on b.v = n.v and b.i = length(n.v)),
    every as (select * from base union all select r, 3, start, stop from guessed where hard),
    joined as (
        select r, {", ".join(f"count(*) filter (kind = {k}) as n_{name}" for k, name in enumerate(KINDS))},
            string_agg({listed(KINDS)}[kind + 1] || ':' || start || ':' || stop, ',' order by start, kind, stop) as spans,
            string_agg({listed(KINDS)}[kind + 1] || ':' || start || ':' || stop, ',' order by start, kind, stop) filter (kind < 3) as base
        from every group by r),
    weak as (select r, count(*) as n_weak from guessed where not hard group by r)
    select doc_id, {", ".join(f"coalesce(n_{name}, 0) as n_{name}" for name in KINDS)}, coalesce(n_weak, 0) as n_weak, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
    from docs left join joined using (r) left join weak using (r)"""
