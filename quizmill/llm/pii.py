"""Personal data in texts: fixed patterns, and a linear-chain conditional random field over word-shape features.

The field is trained from a small labelled table by gradient steps on the conditional likelihood, and decoded by Viterbi in
numpy batches. It finds what the patterns miss, as numbers that stand next to one another or mail addresses with letters
outside ASCII. Words without a digit or ``@`` are labelled O by definition; the runs of other words between them are
independent chains, so decoding them alone is exact.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizmill.llm.common import table

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O",) + tuple(f"{p}-{k}" for k in KINDS for p in "BI")

#: Fixed by the rule: the pattern of each kind. A run of digits of an address is never entered in its middle or given up in
#: part, which changes no match and keeps the search linear; so does looking for mail addresses from their ``@``.
PATTERNS = {
    "ip": re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")

#: The labelled table that the field is trained from: ``[kind:text]`` marks a span. All of it is invented.
LABELLED = (
    "reply to [email:kaja.holm41@post3.example.net] before noon",
    "Unsere Adresse: [email:zoë.krüger@büro.example.at] oder anrufen",
    "von [email:søren@nørre.example.dk], sagte sie",
    "[email:t_vance+list@desk.example.com] [email:q@r.example.io]",
    "Kontakt - [email:m.n@o.example]; merci",
    "vea [email:señor@peña.example] 14 veces",
    "gone @ lunch, x@y is nobody",
    "thanks @river and @press7 for 9 pictures",
    "3@15 apiece, 12@4.75 as well",
    "server [ip:203.0.113.77] answered",
    "between [ip:198.51.100.4] and [ip:192.0.2.250], 6 hops",
    "Porto, [ip:203.0.113.9] of 31 nodes",
    "[ip:192.0.2.0] [ip:198.51.100.200] 8443",
    "listening [ip:192.0.2.18]:9090 now",
    "[ip:203.0.113.41] [card:4072386255118489] seen",
    "[card:5333113879811352] [ip:198.51.100.23] seen",
    "release 4.0.2 and 11.6 of 3.2.1.754",
    "chapter 5.2.8 from page 61",
    "number 412.310.266.900 leads nowhere",
    "charged to [card:4533314789328807] in 9 days",
    "card [card:5333113879811352], valid 08/31",
    "this [card:4072 3862 5511 8489] expired",
    "[card:4312-2200-3869-9673] and [card:428110868127383]",
    "never [card:4897071248107566] 17",
    "invoice 4533314789328801 sent",
    "codes 3397626000705618 and 7402118365520916 differ",
    "batch 8830127745901266 6 of 20",
    "ref 5512098734410028",
    "dial [phone:+1 (202) 555-0143] tonight",
    "[phone:+1 (415) 555-0187] or [phone:+44 1632 960 551] then",
    "Tel. [phone:+49 30 23125 448], Hof 2",
    "mobile [phone:+33 1 99 00 41 62].",
    "office [phone:(0171) 960-0334] only",
    "desk [phone:(202) 555-0166] too",
    "or [phone:0161-496-0217] by 8",
    "try [phone:301.555.0128] from 7",
    "[phone:+61 2 5550 7391] [card:4917964844730979] given",
    "[card:2002011831621645] [phone:+1 (312) 555-0119] Qu",
    "[phone:+1 (646) 555-0175] [ip:192.0.2.66] [card:457337969683618] last",
    "[ip:203.0.113.5] [phone:+1 (702) 555-0102] 4 y",
    "[card:5786364418553458] [card:5868864684141228] both",
    "[card:4039989908091243] [card:3508996141579003] [card:4533314789328807] three",
    "[phone:+1 (206) 555-0151] [phone:+1 (503) 555-0136] both",
    "[email:r.88@box5.example.org] [phone:+1 (808) 555-0190] [card:3945563885345] fine",
    "[phone:+1 (919) 555-0113] 8830127745901266 no payment",
    "8830127745901266 [phone:+1 (904) 555-0158] velum",
    "[card:4897071248107566] 2390 [card:4325248744739]",
    "in 2019-11-03 at 22:45:10 they left",
    "28/02/2021 or 28.02.2021 holds",
    "from 1987 to 2013, 480000 units",
    "price 3,470.00 or 18.49 and 7% of 12",
    "secret = \"5fe1c07a94d23b8860\" stored",
    "hash b7c8d9e0f1a2 or 0xc0ffee77",
    "score 4-1 and 30-45 and 612-08",
    "gate 214 row 9 place 31c",
    "isbn 978-0-00-000000-2 vol 3",
    "21 43 65 87 09 figures here",
    "3 1 4 1 5 9 2 6 5 3 5",
    "rule 8 of act 2004-61",
    "w3 b52 ogg7 latin1 p90",
    "6.25 1.5 0.75 9.875",
)

_MARK = re.compile(r"\[(email|ip|card|phone):([^\]]*)\]")
_ACTIVE = re.compile(r"[0-9@]\S*")
_WORD = re.compile(r"\S+")
_RUNS = re.compile(r"[0-9]+|[^\W\d_]+|.", re.S)
_HEAD, _TAIL = "\"'<[{", ".,;:!?\"'>]}"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def fits(kind: str, s: str) -> bool:
    """Whether a match of the kind's pattern is kept."""
    if kind == "ip":
        return all(len(p) <= 3 and int(p or 0) <= 255 for p in (part.lstrip("0") for part in s.split(".")))
    d = _digits(s)
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d)
    return kind == "email" or 9 <= len(d) <= 15


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each pattern, by kind and start; matches that do not fit are dropped."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            end = host.end()
            out.append(("email", start, end))
        at = text.find("@", max(end, at + 1))
    for kind, pattern in PATTERNS.items():
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if fits(kind, m.group())]
    return out


def shape(word: str) -> str:
    """Digits as their number, letters as a or A, the rest as it is."""
    out = []
    for run in _RUNS.findall(word):
        c = run[0]
        out.append(f"d{len(run)}" if "0" <= c <= "9" else ("A" if run[0].isupper() else "a") if c.isalpha() else c)
    return "".join(out)


def _coarse(word: str | None) -> str:
    if word is None:
        return "edge"
    if "@" in word:
        return "mail"
    n = len(_digits(word))
    return "word" if not n else "plus" if word[0] == "+" else "bracket" if word[0] == "(" else f"num{min(n, 5)}" if n == len(word.strip(_TAIL)) else f"mixed{min(n, 5)}"


def features(words: list[str | None], i: int) -> list[str]:
    """Features of word i and its neighbours."""
    w = words[i].strip(_TAIL).lstrip(_HEAD)
    d = _digits(w)
    out = [f"shape={shape(w)}", f"digits={len(d)}", f"own={_coarse(w)}", f"before={_coarse(words[i - 1])}", f"after={_coarse(words[i + 1])}"]
    out.append(f"before2={_coarse(words[i - 1])}/{_coarse(w)}")
    out.append(f"after2={_coarse(w)}/{_coarse(words[i + 1])}")
    if "@" in w:
        local, _, host = w.partition("@")
        out.append(f"at={bool(local)}{'.' in host.strip('.')}{any(c.isalpha() for c in host)}")
    if 13 <= len(d) <= 19:
        out.append(f"luhn={luhn(d)}")
    parts = w.split(".")
    if len(parts) == 4 and all(p and len(_digits(p)) == len(p) and len(p) < 10 for p in parts):
        out.append(f"ip={all(int(p) <= 255 for p in parts)}")
    return out


def chains(text: str, index: dict[str, int] | None = None) -> list[list[tuple]]:
    """Runs of neighbouring words with a digit or ``@``: (start, end, features) of each word; features as numbers where
    ``index`` gives them, without those that it lacks."""
    found = []
    for m in _ACTIVE.finditer(text):
        start = m.start()
        while start and not text[start - 1].isspace():
            start -= 1
        found.append((start, m.end()))
    out, at = [], 0
    while at < len(found):
        stop = at + 1
        while stop < len(found) and text[found[stop - 1][1] : found[stop][0]].isspace():
            stop += 1
        run = found[at:stop]
        first, last = run[0][0], run[-1][1]
        while first and text[first - 1].isspace():
            first -= 1
        begin = first
        while begin and not text[begin - 1].isspace():
            begin -= 1
        after = _WORD.search(text, last)
        words = [text[begin:first] or None, *(text[a:b] for a, b in run), after.group() if after else None]
        held = (features(words, i + 1) for i in range(len(run)))
        if index is not None:
            held = (tuple(index[f] for f in fs if f in index) for fs in held)
        out.append([(a, b, fs) for (a, b), fs in zip(run, held)])
        at = stop
    return out


@dataclass
class Field:
    index: dict[str, int]
    emit: np.ndarray  # features x labels
    move: np.ndarray  # from x to, with O at both ends

    def emissions(self, run) -> np.ndarray:
        return np.array([self.emit[list(fs)].sum(0) if fs else np.zeros(len(LABELS)) for _, _, fs in run])

    def viterbi(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """The best labels of each chain. Chains of like length are decoded together, 2,000 words of padding at most."""
        out: list = [None] * len(scores)
        order = sorted(range(len(scores)), key=lambda i: len(scores[i]))
        at = 0
        while at < len(order):
            stop = at + 1
            while stop < len(order) and stop - at < 4096 and len(scores[order[stop]]) <= len(scores[order[at]]) + 2000 // (stop - at + 1):
                stop += 1
            group = order[at:stop]
            n = np.array([len(scores[i]) for i in group])
            s = np.zeros((len(group), n.max(), len(LABELS)))
            for k, i in enumerate(group):
                s[k, : n[k]] = scores[i]
            best, back = self.move[0] + s[:, 0], np.zeros(s.shape, np.int8)
            for t in range(1, s.shape[1]):
                step = best[:, :, None] + self.move
                back[:, t] = step.argmax(1)
                best = np.where((t < n)[:, None], step.max(1) + s[:, t], best)
            label = (best + self.move[:, 0]).argmax(1)
            path = np.zeros(s.shape[:2], np.int8)
            for t in range(s.shape[1] - 1, -1, -1):
                path[:, t] = np.where(t < n, label, 0)
                label = np.where(t < n, back[np.arange(len(group)), t, label], label) if t else label
            for k, i in enumerate(group):
                out[i] = path[k, : n[k]]
            at = stop
        return out


def parse_labelled(row: str) -> tuple[str, list[tuple[str, int, int]]]:
    text, spans, at = "", [], 0
    for m in _MARK.finditer(row):
        text += row[at : m.start()]
        spans.append((m[1], len(text), len(text) + len(m[2])))
        text += m[2]
        at = m.end()
    return text + row[at:], spans


def train(rows, steps: int = 250, rate: float = 0.1, penalty: float = 0.01) -> Field:
    """Maximum conditional likelihood with an L2 penalty, by Adam on forward-backward gradients over all chains at once."""
    runs, golds, index = [], [], {}
    for row in rows:
        text, spans = parse_labelled(row)
        for run in chains(text):
            gold = []
            for a, b, fs in run:
                k = next(((kind, s) for kind, s, e in spans if a < e and s < b), None)
                inside = k and gold and gold[-1] and k[1] < a and LABELS[gold[-1]][2:] == k[0]
                gold.append(LABELS.index(f"{'I' if inside else 'B'}-{k[0]}") if k else 0)
                for f in fs:
                    index.setdefault(f, len(index))
            runs.append(run)
            golds.append(gold)
    n, top, labels = len(runs), max(map(len, runs)), len(LABELS)
    x, y, live = np.zeros((n, top, len(index))), np.zeros((n, top), int), np.zeros((n, top), bool)
    for i, (run, gold) in enumerate(zip(runs, golds)):
        for t, (_, _, fs) in enumerate(run):
            x[i, t, [index[f] for f in fs]] = 1
            y[i, t], live[i, t] = gold[t], True
    size, rng = live.sum(1), np.arange(n)
    emit, move = np.zeros((len(index), labels)), np.zeros((labels, labels))
    gold_emit = np.einsum("ntf,ntl->fl", x, np.eye(labels)[y] * live[:, :, None])
    gold_move = np.zeros_like(move)
    for gold in golds:
        for a, b in zip([0, *gold], [*gold, 0]):
            gold_move[a, b] += 1

    def lse(v, axis):
        m = v.max(axis, keepdims=True)
        return np.squeeze(m, axis) + np.log(np.exp(v - m).sum(axis))

    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (emit, move)]
    for step in range(1, steps + 1):
        s = x @ emit
        alpha, beta = np.zeros((n, top, labels)), np.zeros((n, top, labels))
        alpha[:, 0] = move[0] + s[:, 0]
        for t in range(1, top):
            alpha[:, t] = lse(alpha[:, t - 1, :, None] + move, 1) + s[:, t]
        for t in range(top - 1, -1, -1):
            later = lse(move + (s[:, t + 1] + beta[:, t + 1])[:, None, :], 2) if t + 1 < top else 0
            beta[:, t] = np.where((t == size - 1)[:, None], move[:, 0], later)
        z = lse(alpha[rng, size - 1] + move[:, 0], 1)
        p = np.exp(alpha + beta - z[:, None, None]) * live[:, :, None]
        want = np.zeros_like(move)
        want[0] += p[:, 0].sum(0)
        want[:, 0] += p[rng, size - 1].sum(0)
        for t in range(1, top):
            pair = np.exp(alpha[:, t - 1, :, None] + move + (s[:, t] + beta[:, t])[:, None, :] - z[:, None, None])
            want += pair[live[:, t]].sum(0)
        for value, g, mo in ((emit, np.einsum("ntf,ntl->fl", x, p) - gold_emit + penalty * emit, moments[0]), (move, want - gold_move + penalty * move, moments[1])):
            mo[0] = 0.9 * mo[0] + 0.1 * g
            mo[1] = 0.999 * mo[1] + 0.001 * g * g
            value -= rate * (mo[0] / (1 - 0.9**step)) / (np.sqrt(mo[1] / (1 - 0.999**step)) + 1e-8)
    return Field(index, emit, move)


def field_spans(text: str, runs, labels) -> list[tuple[str, int, int]]:
    """Spans of the decoded labels, without marks at their ends, that fit their kind (phones from 9 digits)."""
    out: list = []
    for run, path in zip(runs, labels):
        last = None
        for (a, b, _), k in zip(run, path):
            name = LABELS[k]
            if k and name[0] == "I" and last and last[0] == name[2:]:
                last[2] = b
            elif k:
                last = [name[2:], a, b]
                out.append(last)
            else:
                last = None
    found = []
    for kind, a, b in out:
        while a < b and text[a] in _HEAD:
            a += 1
        while a < b and text[b - 1] in _TAIL:
            b -= 1
        s = text[a:b]
        if kind == "ip":
            s = s.partition(":")[0]
            b = a + len(s)
        if kind == "ip" and not PATTERNS["ip"].fullmatch(s) or kind == "email" and not re.fullmatch(r"[^@\s]+@[^@\s.]+(\.[^@\s.]+)+", s):
            continue
        if s and fits(kind, s):
            found.append((kind, a, b))
    return found


def free_spans(base, more) -> list[tuple[str, int, int]]:
    """Those of ``more`` that share no character with any span of ``base``, whose spans may overlap across kinds."""
    starts, ends = [], []
    for _, a, b in sorted(base, key=lambda x: x[1]):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    out = []
    for kind, a, b in more:
        at = bisect_right(ends, a)
        if at == len(starts) or starts[at] >= b:
            out.append((kind, a, b))
    return out


SCHEMA = "doc_id long, spans array<struct<kind: string, start: int, end: int, source: string>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("source", pa.string())]))


def _find_rows(batches, model: Field):
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            texts = [t or "" for t in part.column(1).to_pylist()]
            active = [bool(_ACTIVE.search(t)) for t in texts]
            runs = [chains(t, model.index) if a else [] for t, a in zip(texts, active)]
            flat = [r for rs in runs for r in rs]
            paths = iter(model.viterbi([model.emissions(r) for r in flat])) if flat else iter(())
            out = []
            for text, rs, a in zip(texts, runs, active):
                base = base_spans(text) if a else []
                more = field_spans(text, rs, [next(paths) for _ in rs])
                added = free_spans(base, more)
                every = [(k, s, e, "pattern") for k, s, e in base] + [(k, s, e, "field") for k, s, e in added]
                every.sort(key=lambda x: (KINDS.index(x[0]), x[1]))
                out.append([dict(zip(("kind", "start", "end", "source"), x)) for x in every])
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(out, _SPANS)], names=["doc_id", "spans"])


def labelled_table(spark: SparkSession) -> DataFrame:
    """The small labelled table, one marked sentence a row; callers may pass their own."""
    return spark.createDataFrame([(r,) for r in LABELLED], "marked string")


def find_pii(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """``doc_id, spans``: per document the spans of personal data, by kind (email, ip, card, phone) and start.

    Offsets are code points, the end exclusive. Time is linear in the text, whatever it is made of. ``source`` is ``pattern`` for the fixed patterns, which all stay, or
    ``field`` for spans that the field adds where none of the patterns has matched. Every whole text is read; one pass,
    no shuffle. The field is trained on the driver from all sentences of ``labelled``, in sorted order; the driver
    holds them, so they should be few.

    Edge cases: null and empty texts have no spans; rows that repeat an id are searched each; a null id is searched too;
    an empty table gives an empty table; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = list(LABELLED) if labelled is None else sorted(r[0] for r in labelled.collect())
    sent = spark.sparkContext.broadcast(train(rows))
    return docs.select("doc_id", "text").mapInArrow(lambda it: _find_rows(it, sent.value), SCHEMA)


def redact(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``doc_id, text`` with every span replaced by its kind in brackets."""
    def cut(acc, s):
        skip = s["start"] < acc["at"]
        text = F.concat(acc["done"], F.substring("text", acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]"))
        return F.struct(F.when(skip, acc["done"]).otherwise(text).alias("done"), F.greatest(acc["at"], s["end"]).alias("at"))

    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    folded = F.aggregate(ordered, F.struct(F.lit("").alias("done"), F.lit(0).alias("at")), cut)
    both = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(spans.select("doc_id", "spans"), "doc_id")
    folded = both.select("doc_id", "text", folded.alias("f"))
    return folded.select("doc_id", F.concat("f.done", F.substring("text", F.col("f.at") + 1, F.length("text"))).alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    out = find_pii(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["source"] == "pattern")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS]
    return out.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


ORACLE_SQL = None  # the field's spans have no SQL form; tests check the patterns against plain loops and planted cases
