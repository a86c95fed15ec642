"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs them.

Candidates are what the base patterns find and what looser patterns find besides. Regex, structure, gazetteer and
context labelers vote yes, no or nothing on each. Spark counts the vote patterns of all candidates; their number is bounded
by the labelers, not by the data. EM estimates from these counts how reliable each labeler is and how likely each
candidate is real, and a logistic span classifier learns that from the shape and the votes of a span. Base spans
always stand; the classifier adds others that pass the check of their kind.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.batches import arrow_column, arrow_map, id_and_text, record_batch, slices, texts
from shelfmark.operators.workspace import written

KINDS = ("email", "ip", "card", "phone")

# The base patterns.
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: The same matches in time that grows with the text: a run of local characters or digits is passed over as a whole, since
#: where its start gives no match none of its other places does. The email pattern also takes runs without one.
SCANNED = BASE | {
    "email": re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)?"),
    "ip": re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
}
#: Looser patterns, which also find what a greedy base match has swallowed together with its neighbour.
LOOSE = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+ ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]+(?:(?:\.| ?\[dot\] ?| ?\(dot\) ?)[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])"),
    "card": re.compile(r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|3[0-9]{3}([ -])[0-9]{6}\2[0-9]{5})(?![0-9A-Za-z])"),
    "phone": re.compile(r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})|\([0-9]{3}\))(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9A-Za-z]|\.[0-9])"),
}
# Gazetteers: fixed values of public registries.
TOP_DOMAINS = {"com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "io", "co", "de", "fr", "es", "uk", "eu", "it", "nl", "ch", "at", "be", "us", "ca", "au", "jp", "cn", "in", "br", "ru", "pl", "se", "no", "dk", "fi", "pt", "mx", "ar"}
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "351", "352", "353", "354", "358", "370", "371", "372", "380", "385", "386", "420", "421", "852", "886", "966", "971", "972")
CUES = {
    "email": ("mail", "contact", "write"), "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "mastercard", "amex", "credit"), "phone": ("phone", "tel", "call", "mobile", "fax"),
}
AGAINST = ("token", "hash", "sha", "md5", "version", "isbn", "id", "key")
CONTEXT = 32


def digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def passes(kind: str, s: str) -> bool:
    """The check that a span of this kind must pass."""
    if kind == "ip":
        return all(len(p) <= 3 and int(p or 0) <= 255 for p in (p.lstrip("0") for p in s.split(".")))
    if kind == "card":
        n = digits(s)
        return 14 <= len(n) <= 19 and luhn(n)
    if kind == "phone":
        return 10 <= len(digits(s)) <= 15
    return True


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) by start, then kind."""
    found = []
    for k, kind in enumerate(KINDS):
        if kind == "email" and "@" not in text or kind == "phone" and "+" not in text:
            continue
        matches = (m for m in SCANNED[kind].finditer(text) if kind != "email" or m[1])
        found += [(m.start(), k, m.end()) for m in matches if passes(kind, m[0])]
    return sorted(found)


class Covered:
    """What a set of spans covers, as sorted intervals that do not touch."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end in sorted(spans):
            if self.ends and start <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def meets(self, start: int, end: int) -> bool:
        at = bisect_left(self.starts, end) - 1
        return at >= 0 and self.ends[at] > start


def votes(kind: str, text: str, start: int, end: int, base: bool) -> str:
    """One letter for each labeler: y, n or - for nothing."""
    s = text[start:end]
    structure = "y" if passes(kind, s) else "n"
    if kind == "email":
        gazetteer = "y" if re.split(r"[^A-Za-z0-9-]+", s.rstrip("])"))[-1].lower() in TOP_DOMAINS else "-"
        shape = "y" if "@" in s else "n"
    elif kind == "ip":
        first = s.split(".", 1)[0][:4]
        gazetteer = "n" if int(first) in (0, 127) or int(first) >= 240 else "y"
        shape = "n" if any(len(p) > 1 and p[0] == "0" for p in s.split(".")) else "y"
    elif kind == "card":
        n = digits(s)
        issued = n[0] == "4" or n[:2] in ("34", "37", "65") or n[:4] == "6011" or 51 <= int(n[:2]) <= 55 or 2221 <= int(n[:4]) <= 2720
        gazetteer = "y" if issued else "-"
        parts = re.split("[ -]", s)
        shape = "y" if len(parts) == 1 or all(len(p) == 4 for p in parts[:-1]) else "n"
    else:
        gazetteer = "y" if s[0] == "+" and s[1:].startswith(CALLING_CODES) else "-"
        shape = "y" if s[0] == "+" and re.search(r"[ ().-]", s) else "-"
    left, right = text[start - 1 : start], text[end : end + 1]
    alone = "n" if left.isalnum() or right.isalnum() else "y"
    around = re.findall(r"[a-z]+", text[max(0, start - CONTEXT) : start].lower())[-4:]
    cue = "y" if any(w.startswith(c) for w in around for c in CUES[kind]) else "n" if any(w in AGAINST for w in around) else "-"
    return ("y" if base else "-") + structure + gazetteer + shape + alone + cue


def cell(kind: str, text: str, start: int, end: int) -> str:
    """The shape of a span in a few letters, so that there are few different ones."""
    s, side = text[start:end], lambda c: "a" if c.isalnum() else "s" if c.isspace() or not c else "p"
    share = sum(c.isdigit() for c in s) / len(s)
    return f"{KINDS.index(kind)}{min(9, (end - start) // 4)}{int(share * 3.99)}{'+' if s[0] == '+' else '('  if '(' in s else '.'}{side(text[start - 1 : start])}{side(text[end : end + 1])}"


def candidates(text: str) -> list[dict]:
    """Base spans and loose ones that overlap no base span and no earlier loose one of their kind, in time n log n."""
    if not re.search(r"[0-9@]|at[\])]", text):
        return []
    base = base_spans(text)
    out = [(s, k, e, True) for s, k, e in base]
    covered = Covered([(s, e) for s, _, e in base])
    for k, kind in enumerate(KINDS):
        for m in LOOSE[kind].finditer(text):
            if not covered.meets(*m.span()):
                out.append((m.start(), k, m.end(), False))
    return [
        {
            "kind": k, "start": s, "end": e, "base": b, "passes": passes(KINDS[k], text[s:e]),
            "votes": votes(KINDS[k], text, s, e, b), "cell": cell(KINDS[k], text, s, e),
        }
        for s, k, e, b in sorted(out)
    ]


SPAN = pa.struct(
    [("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("passes", pa.bool_()),
     ("votes", pa.string()), ("cell", pa.string())]
)
SPAN_DDL = "struct<kind:int, start:int, end:int, base:boolean, passes:boolean, votes:string, cell:string>"
FOUND = pa.schema([("id", pa.int64()), ("found", pa.list_(SPAN))])


def find_candidates(ids: DataFrame) -> DataFrame:
    """(id, found) of rows (id, text): the candidates of every text, most often none."""

    def run(batches):
        for b in slices(batches):
            yield record_batch(FOUND, b.column(0), [candidates(t) for t in texts(b, 1)])

    return arrow_map(ids, run, f"id long, found array<{SPAN_DDL}>")


@dataclass
class Model:
    """reliability: of each kind and labeler the chances of y, n and - for real and for unreal spans."""

    reliability: dict[tuple[int, int], dict[str, tuple[float, float]]]
    prior: dict[int, float]
    weights: dict[str, float]

    def probability(self, kind: int, votes: str, cell: str) -> float:
        return 1 / (1 + math.exp(-sum(self.weights.get(f, 0.0) for f in span_features(kind, votes, cell))))

    def accepts(self, c: dict) -> bool:
        return c["base"] or (c["passes"] and self.probability(c["kind"], c["votes"], c["cell"]) >= 0.5)


def span_features(kind: int, votes: str, cell: str) -> list[str]:
    """What the classifier sees of a span. Its votes count alike for all kinds, its shape for each by itself."""
    return [f"kind{kind}", *(f"vote{i}{v}" for i, v in enumerate(votes)), *(f"shape{kind}{i}{c}" for i, c in enumerate(cell[1:]))]


def estimate(counts: dict[tuple[int, str], float], rounds: int = 50) -> tuple[dict, dict, dict]:
    """EM over vote patterns (kind, votes) -> how many: reliabilities, shares of real spans, and the posterior of
    each pattern. It starts from the majority of votes; every chance has a pseudo-count, yes with real and no with unreal."""
    posterior = {p: (1.5 + p[1].count("y") - p[1].count("n")) / (3 + sum(v != "-" for v in p[1])) for p in counts}
    posterior = {p: min(0.95, max(0.05, q)) for p, q in posterior.items()}
    reliability, prior = {}, {}
    for _ in range(rounds):
        for kind in {k for k, _ in counts}:
            own = {p: n for p, n in counts.items() if p[0] == kind}
            real, every = sum(n * posterior[p] for p, n in own.items()), sum(own.values())
            prior[kind] = (real + 1) / (every + 2)
            for i in range(6):
                table = {}
                for v, (good, bad) in {"y": (4, 1), "n": (1, 4), "-": (2, 2)}.items():
                    yes = sum(n * posterior[p] for p, n in own.items() if p[1][i] == v)
                    no = sum(n * (1 - posterior[p]) for p, n in own.items() if p[1][i] == v)
                    table[v] = ((yes + good) / (real + 7), (no + bad) / (every - real + 7))
                reliability[kind, i] = table
        for kind, pattern in counts:
            odds = math.log(prior[kind] / (1 - prior[kind]))
            for i, v in enumerate(pattern):
                good, bad = reliability[kind, i][v]
                odds += math.log(good / bad)
            posterior[kind, pattern] = 1 / (1 + math.exp(-max(-30, min(30, odds))))
    return reliability, prior, posterior


def train(rows: list[tuple[int, str, str, int]], steps: int = 300) -> Model:
    """A model from (kind, votes, cell, how many), all different."""
    counts: dict[tuple[int, str], float] = {}
    for kind, pattern, _, n in rows:
        counts[kind, pattern] = counts.get((kind, pattern), 0) + n
    reliability, prior, posterior = estimate(counts)
    names = sorted({f for kind, v, c, _ in rows for f in span_features(kind, v, c)})
    place = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    for r, (kind, v, c, _) in enumerate(rows):
        x[r, [place[f] for f in span_features(kind, v, c)]] = 1
    y = np.array([posterior[kind, v] for kind, v, _, _ in rows])
    n = np.array([math.sqrt(k) for *_, k in rows])  # a very common shape must not drown the others
    n = n / max(1.0, n.sum())
    w, m, s = np.zeros(len(names)), np.zeros(len(names)), np.zeros(len(names))
    for t in range(1, steps + 1):
        g = x.T @ (n * (1 / (1 + np.exp(-x @ w)) - y)) + 1e-4 * w
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return Model(reliability, prior, dict(zip(names, w.tolist())))


def learn(found: DataFrame) -> Model:
    """Counts vote patterns and shapes over all candidates; what comes to the driver is bounded by their number."""
    spans = found.where(F.size("found") > 0).select(F.explode("found").alias("c"))
    counted = spans.groupBy("c.kind", "c.votes", "c.cell").count().orderBy("kind", "votes", "cell")
    return train([tuple(r) for r in counted.collect()])


def accepted(model: Model, found: list[dict]) -> list[tuple[int, int, int, bool]]:
    """(start, kind, end, base): all base spans, and others that the model accepts and that overlap nothing taken."""
    taken = [(c["start"], c["kind"], c["end"], True) for c in found if c["base"]]
    covered, reach = Covered([(s, e) for s, _, e, _ in taken]), 0
    for c in sorted((c for c in found if not c["base"]), key=lambda c: (c["start"], -c["end"], c["kind"])):
        if c["start"] >= reach and model.accepts(c) and not covered.meets(c["start"], c["end"]):
            taken.append((c["start"], c["kind"], c["end"], False))
            reach = c["end"]
    return sorted(taken)


DIGESTS = pa.schema(
    [("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())]
)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of every row the numbers of base spans of each kind, their digest, and all spans as kind:start:end, in code points.

    A null or empty text has none; repeated rows give repeated results.
    """
    found = written(find_candidates(id_and_text(docs, id_col, text_col)), "pii-candidates")
    model = learn(found)

    def run(batches):
        for b in slices(batches, 4096):
            rows = []
            for spans in b.column(1).to_pylist():
                spans = accepted(model, spans or [])
                base = [s for s in spans if s[3]]
                counts = [sum(k == i for _, k, _, _ in base) for i in range(len(KINDS))]
                said = [",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in part) for part in (base, spans)]
                rows.append((*counts, hashlib.sha256(said[0].encode()).hexdigest(), said[1]))
            yield record_batch(DIGESTS, b.column(0), *(list(c) for c in zip(*rows)))

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return arrow_map(found, run, f"doc_id long, {counts}, base_sha256 string, spans string")


def redact(text: str, model: Model) -> str:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans the first stands for both."""
    out, at = [], 0
    for start, kind, end, _ in accepted(model, candidates(text)):
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]]) if at else text


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """All rows and columns, personal data in the text replaced; length_col, if any, is the new length.

    Null texts stay null, rows that repeat stay repeated, and an empty table gives an empty one."""
    model = learn(written(find_candidates(id_and_text(docs, id_col, text_col)), "pii-candidates"))

    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if t is None else redact(t, model) for t in column.to_pylist()], pa.string())

    out = docs.withColumn(text_col, arrow_column(run, "string", F.col(f"`{text_col}`").cast("string")))
    if length_col:
        out = out.withColumn(length_col, F.length(f"`{text_col}`").cast(docs.schema[length_col].dataType))
    return out.select(*(f"`{c}`" for c in docs.columns))
