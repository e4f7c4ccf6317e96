"""Personal data: fixed patterns as seeds, and bootstrapped contextual extraction of further identifiers."""

import bisect
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import columns, fresh, small, stage, tidy

KINDS = ("email", "ip", "card", "phone")

# The base patterns, in forms that never look back over a long run: fixed values.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")

TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
LOOKS_ODD = re.compile(r"[0-9@]")
TRIM = ".,;:!?()[]{}<>\"'=|#*&$%"
PUNCTUATION = TRIM.replace("(", "").replace(")", "")
NUMERIC = re.compile(r"[\x20\x090-9()+./-]+")
GROUPS = re.compile(r"[0-9A-Fa-f]+(?:[.:][0-9A-Fa-f]*){3,}")
QUAD = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}")
LINE = re.compile(r"[\x0A-\x0D]")
CONTEXT = 32  # characters of a context word that a pattern keeps

ROUNDS = 4
MIN_SEEDS = 5         # different seeds or found identifiers that a pattern must stand at
MIN_CONFIDENCE = 0.8  # of a pattern, and of a found identifier


def emails(text):
    found, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            found.append((start, match.end()))
            done = match.end()
        at = text.find("@", max(at + 1, done))
    return found


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text):
    """(start, kind, end) of the fixed patterns, by start, then kind as listed; code points, end exclusive."""
    out = []
    if "@" in text:
        out += [(s, 0, e) for s, e in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0]) if len(m[0]) <= 64 else ""
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def kinds_of(token):
    """Kinds that a token, or a run of tokens, may be of by its characters alone: an at sign; four or more groups split by
    dots or colons; digits and separators, at least 7 for a phone and 12 for a card."""
    if "@" in token:
        return [0]
    out = [1] if GROUPS.fullmatch(token) else []
    if NUMERIC.fullmatch(token) and not QUAD.fullmatch(token):
        digits = len(NOT_DIGIT.sub("", token))
        out += [k for k, least in ((2, 12), (3, 7)) if digits >= least]
    return out


def _context(word):
    return re.sub(r"[0-9]+", "9", word.strip(TRIM).lower()[:CONTEXT])


def _inner(text, start, end, more=""):
    """(start, end) without punctuation around, signs of ``more`` included, and without parentheses that have no partner inside."""
    while start < end and (text[start] in PUNCTUATION or text[start] == ")" or text[start] in more):
        start += 1
    while end > start and (text[end - 1] in PUNCTUATION or text[end - 1] == "(" or text[end - 1] in more or more and text[end - 1] == "+"):
        end -= 1
    opened, closed = text.count("(", start, end), text.count(")", start, end)
    if start < end and text[end - 1] == ")" and closed > opened:
        end, closed = end - 1, closed - 1
    if start < end and text[start] == "(" and (opened > closed or text[end - 1] == ")" and opened == closed == 1):
        start, opened = start + 1, opened - 1
        if start < end and text[end - 1] == ")" and closed > opened:
            end -= 1
    return start, end


def runs(text, words):
    """Maximal runs of neighbouring words of digits and separators on a line, as lists of words. Punctuation ends a run."""
    out, current = [], []
    for start, end in words:
        first, last = start, end
        while first < last and text[first] in PUNCTUATION:
            first += 1
        while last > first and text[last - 1] in PUNCTUATION:
            last -= 1
        if first == last or not NUMERIC.fullmatch(text, first, last):
            current = []
            continue
        if not current or first > start or LINE.search(text, current[-1][1], start):
            current = []
            out.append(current)
        current.append((start, end))
        if last < end:
            current = []
    return out


def candidates(text, spans):
    """(start, end, kind or -1, instance, left word, right word, kinds it may be of, start of its run, whether it is a run)
    of the spans, of all other words that hold a digit or an at sign, and of the runs of such words of digits and separators.
    What lies inside a run is a candidate of its own if it is long enough for a base pattern."""
    if not spans and not LOOKS_ODD.search(text):
        return []
    taken = sorted((s, e) for s, _, e in spans)
    odd = [(s, e, k, s, False) for s, k, e in spans]
    words = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
    free, breaks, position = [], [[]], 0
    for start, end in words:
        first, last = _inner(text, start, end)
        while position < len(taken) and taken[position][1] <= first:
            position += 1
        if any(s < last and first < e for s, e in taken[max(0, position - 4):position + 4]):
            breaks.append([])
            continue
        breaks[-1].append((start, end))
        if LOOKS_ODD.search(text, first, last):
            free.append((start, first, last))
    run_of = {}
    for part in breaks:
        for run in runs(text, part):
            first, last = _inner(text, run[0][0], run[-1][1], " \t-/")
            if len(run) > 1 and len(TOKEN.findall(text, first, last)) > 1:
                run_of.update((start, first) for start, _ in run)
                odd.append((first, last, -1, first, True))
    for start, first, last in free:
        if start not in run_of or GROUPS.fullmatch(text, first, last) or len(NOT_DIGIT.sub("", text[first:last])) >= 10:
            odd.append((first, last, -1, run_of.get(start, first), False))
    starts = [s for s, _ in words]
    out = []
    for start, end, kind, whole, run in odd:
        token = text[start:end]
        may = kinds_of(token)
        if kind >= 0 and kind not in may:
            may.append(kind)
        if not may:
            continue
        left = bisect.bisect_right(starts, start) - 1
        right = bisect.bisect_left(starts, end)
        if left >= 0 and words[left][0] >= start - len(TRIM) and words[left][1] > start:
            left -= 1
        before = _context(text[words[left][0]:words[left][1]]) if left >= 0 else "^"
        after = _context(text[words[right][0]:words[right][1]]) if right < len(words) else "$"
        out.append((start, end, kind, hashlib.blake2b(token.lower().encode(), digest_size=16).hexdigest(), before, after, may, whole, run))
    return out


def spell(spans):
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


CANDIDATE = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("instance", pa.string()),
                       ("left", pa.string()), ("right", pa.string()), ("may", pa.list_(pa.int32())), ("whole", pa.int32()), ("run", pa.bool_())])
SCHEMA = ("doc_id {}, hash long, n_email long, n_ip long, n_card long, n_phone long, base string, "
          "found array<struct<start:int,end:int,kind:int,instance:string,left:string,right:string,may:array<int>,whole:int,run:boolean>>")


def _scan(batches):
    names = [field.name for field in CANDIDATE]
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            counts, base, found = [], [], []
            for text in part.column("text").to_pylist():
                text = text or ""
                spans = base_spans(text)
                counts.append([sum(k == kind for _, k, _ in spans) for kind in range(4)])
                base.append(spell(spans))
                found.append([dict(zip(names, c)) for c in candidates(text, spans)])
            columns_ = [pa.array([c[k] for c in counts], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("hash"), *columns_, pa.array(base, pa.string()), pa.array(found, pa.list_(CANDIDATE))],
                ["doc_id", "hash", "n_email", "n_ip", "n_card", "n_phone", "base", "found"])


def learn_patterns(spots: DataFrame, rounds=ROUNDS, min_seeds=MIN_SEEDS, least=MIN_CONFIDENCE) -> DataFrame:
    """spots (kind or -1, instance, left, right, may) -> (instance, to, score): identifiers that are no seeds, with
    the kind that their contexts say.

    A pattern is a word to the left or to the right, with a kind; it stands at the instances that may be of the kind. Its
    score is their mean score (seeds: 1 for their kind); an instance's score for a kind is the mean over its patterns,
    weighted by how often it stands there. A pattern speaks from a score of ``least`` on, if it stands at ``min_seeds`` different seeds or identifiers found in the
    round before, so that found ones make further patterns heard. One that does not speak counts as 0 if it stands at
    ``min_seeds`` seeds, else not at all. Edges are counted before they are shuffled; hot patterns and
    instances are aggregated map-side, and adaptive execution can split the joins."""
    sides = F.array(F.concat_ws("\x01", F.lit("l"), "left", "to"), F.concat_ws("\x01", F.lit("r"), "right", "to"))
    edges = stage(spots.select("*", F.explode("may").alias("to")).select("kind", "instance", "to", F.explode(sides).alias("pattern")).groupBy(
        "kind", "instance", "to", "pattern").agg(F.count("*").alias("n")))
    # a pattern that stands at too few instances of any kind can never be heard
    sized = small(stage(edges.groupBy("pattern").agg(F.count("*").alias("size"), F.count_if(F.col("kind") == F.col("to")).alias("seeds")).where(
        F.col("size") >= min_seeds)))
    open_ = stage(edges.where("kind < 0").join(sized.select("pattern"), "pattern", "left_semi").select("pattern", "instance", "to", "n"))
    scores = None
    for _ in range(rounds):
        known = sized.withColumns({"more": F.lit(0.0), "firm": F.lit(0)})
        if scores is not None:
            told = open_.join(small(scores), ["instance", "to"]).groupBy("pattern").agg(
                F.sum("score").alias("more"), F.count_if(F.col("score") >= least).alias("firm"))
            known = sized.join(small(stage(told)), "pattern", "left").fillna(0, ["more", "firm"])
        weight = (F.col("seeds") + F.col("more")) / F.col("size")
        speaks = (F.col("seeds") + F.col("firm") >= min_seeds) & (weight >= least)
        voices = known.where(speaks | (F.col("seeds") >= min_seeds)).select("pattern", F.when(speaks, weight).otherwise(0.0).alias("weight"))
        fresh = open_.join(small(stage(voices)), "pattern").groupBy("instance", "to").agg(
            (F.sum(F.col("n") * F.col("weight")) / F.sum("n")).alias("score")).where("score > 0")
        scores = stage(fresh)
        if not scores.limit(1).count():
            break
    best = scores.groupBy("instance").agg(F.max(F.struct("score", -F.col("to"))).alias("x")).select(
        "instance", (-F.col("x.col2")).alias("to"), F.col("x.score").alias("score"))
    return best.where(F.col("score") >= least)


def _keyed(docs, id_col, text_col):
    return columns(docs, doc_id=id_col, text=text_col).withColumn("text", F.col("text").cast("string")).withColumn("hash", F.xxhash64("text"))


def find_personal_data(docs: DataFrame, id_col="doc_id", text_col="text", rounds=ROUNDS, min_seeds=MIN_SEEDS,
                       least=MIN_CONFIDENCE) -> DataFrame:
    """doc_id, hash, n_email, n_ip, n_card, n_phone, base_sha256, spans, added for each row of ``docs``.

    The base patterns are searched in whole texts, in time in proportion to the text. Their finds are the seeds of
    ``learn_patterns``; words with a digit or an at sign, and runs of words of digits and separators on a line, that are no
    seeds and reach the confidence ``least`` are added as spans of the kind learned. ``spans`` lists all, ``added`` the learned ones alone; the counts are those of the base.

    A null text is an empty one. Ids may be null or repeated; rows that repeat an id and a text get the same result.
    An empty table gives no rows."""
    rows = _keyed(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    scanned = stage(rows.mapInArrow(tidy(_scan), SCHEMA.format(kind)))
    spots = stage(scanned.where("size(found) > 0").select("doc_id", "hash", F.inline("found")))
    learned = stage(learn_patterns(spots, rounds, min_seeds, least))
    more = spots.where("kind < 0").join(small(learned), "instance").select(
        "doc_id", "hash", "whole", "run", F.struct(F.col("start"), F.col("to"), F.col("end")).alias("span"))
    # a run that is found stands for what lies inside it
    parts = more.groupBy("doc_id", "hash", "whole").agg(F.max("run").alias("run"), F.max_by("span", "run").alias("longest"),
                                                        F.collect_set("span").alias("all"))
    spans = F.when(F.col("run"), F.array("longest")).otherwise(F.col("all"))
    added = stage(parts.groupBy("doc_id", "hash").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set(spans)))).alias("added")))
    names = F.array(*map(F.lit, KINDS))
    key = lambda x: F.struct(x["start"], x["to"], x["end"])
    base = F.transform(F.filter(F.split("base", ","), lambda x: x != ""), lambda x: F.struct(
        F.element_at(F.split(x, ":"), 2).cast("int").alias("start"),
        (F.array_position(names, F.element_at(F.split(x, ":"), 1)) - 1).cast("int").alias("to"),
        F.element_at(F.split(x, ":"), 3).cast("int").alias("end")))
    same = scanned.doc_id.eqNullSafe(F.col("_id")) & (scanned.hash == F.col("_hash"))
    whole = scanned.drop("found").join(small(added.select(
        F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"), "added")), same, "left")
    every = F.array_sort(F.transform(F.concat(base, F.coalesce("added", F.array().cast("array<struct<start:int,to:int,end:int>>"))), key))
    text = lambda x: F.concat_ws(":", F.element_at(names, x["to"] + 1), x["start"], x["end"])
    return whole.select(
        "doc_id", "hash", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"),
        F.array_join(F.transform(every, lambda x: text(F.struct(x["start"], x["to"], x["end"]))), ",").alias("spans"), "added")


def mask(text, spans):
    """``text`` with each span replaced by its kind in angle brackets; spans that overlap become one, of the first's kind."""
    out, at = [], 0
    for start, kind, end in sorted(spans):
        if start < at:
            at = max(at, end)
            continue
        out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = end
    return "".join(out) + text[at:]


def _redact(text_col):
    def run(batches):
        for batch in batches:
            place = batch.schema.get_field_index(text_col)
            more = batch.column(batch.num_columns - 1).to_pylist()
            texts = []
            for text, extra in zip(batch.column(place).to_pylist(), more):
                spans = base_spans(text) if text else []
                spans += [(x["start"], x["to"], x["end"]) for x in extra or []]
                texts.append(mask(text, spans) if spans else text)
            made = list(batch.columns[:-1])
            made[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(made, batch.schema.names[:-1])
    return run


def redact(docs: DataFrame, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """``docs`` with the spans of ``find_personal_data`` masked in their texts; rows and other columns stay, whatever their
    names. Null and empty texts stay as they are, rows without id are masked too, repeated rows alike. An empty table gives no rows."""
    of, print_, more = fresh(docs, "_id", "_hash", "_added")
    found = find_personal_data(docs, id_col, text_col, **options).where("added IS NOT NULL").select(
        F.col("doc_id").alias(of), F.col("hash").alias(print_), F.col("added").alias(more)).dropDuplicates([of, print_])
    found = stage(found)
    same = docs[id_col].eqNullSafe(found[of]) & (F.xxhash64(docs[text_col].cast("string")) == found[print_])
    return docs.join(small(found), same, "left").select(*[docs[c] for c in docs.columns], found[more]).mapInArrow(tidy(_redact(text_col)), docs.schema)
