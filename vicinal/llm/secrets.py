"""Secrets in texts: fixed patterns, and automata learned from what they find that score every other candidate."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vicinal.llm.base import dropped, table, written
from vicinal.llm.flat import parts
from vicinal.llm.grammar import Automaton

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KEYWORDS = ("passw", "secret", "token", "api")
KINDS = {"assign": 0, "access": 1, "hex": 2, "format": 3}
#: A candidate is a whole run of credential characters, this long at least; = only ends one, as padding does.
LEAST = 12
RUN = re.compile(r"[A-Za-z0-9+/_.-]{12,}={0,2}")
#: What stands before a value that is a credential, whatever it looks like; wider than the base patterns' keywords.
CONTEXT = re.compile(r"""(?ai:(?:pass|pwd|secret|token|key|auth|cred|private|signature)[A-Za-z0-9_.-]{0,20}["']?\x20*(?:[:=]\x20*|\x20)(?:bearer\x20|basic\x20)?["']?)$""")
BEFORE = 60
DECIMAL = re.compile(r"[0-9]+")
#: Labelled runs that the automata are learned from: SAMPLE of each label at most, of each shape in turn, EACH of a shape at most, by
#: least hash. Of a longer run the first LONGEST characters teach; scores are of whole runs.
SAMPLE, EACH, LONGEST, ROUNDS = 1500, 200, 128, 3
#: Shares that a shape's runs are ranked in first.
SHARES = 32
#: A candidate is a secret if the credentials' automaton makes it e ** MARGIN times as likely as the other runs' does.
MARGIN = 10.0
#: Scored runs that a worker keeps; a full store starts anew.
STORE = 200_000


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the secret itself) by start, then kind."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in RUN.finditer(text)]


def labelled(text: str) -> Iterator[tuple[bool, str]]:
    """Candidate runs with their label. True: a base secret begins in the run, other than a plain number, or the run stands behind
    an assignment to a credential. False: neither. Plain numbers elsewhere have no label: cards and keys look alike."""
    found = [(s, e) for _, k, e, s in base_spans(text) if k < 2 or not DECIMAL.fullmatch(text, s, e)]
    k = 0
    for a, b in candidates(text):
        while k < len(found) and found[k][0] < a:
            k += 1
        secret = (k < len(found) and found[k][0] < b) or CONTEXT.search(text[max(0, a - BEFORE) : a]) is not None
        if secret or not DECIMAL.fullmatch(text, a, b):
            yield secret, text[a:b]


_CLASS = re.compile(r"[A-Za-z0-9]+")


def shape(run: str) -> str:
    """Which kinds of characters each stretch between marks has: 1.2.3 is 9.9.9, sk_1fA is a_9Aa."""

    def kinds(m: re.Match) -> str:
        x = m[0]
        return ("9" if any(c.isdigit() for c in x) else "") + ("A" if x.lower() != x else "") + ("a" if x.upper() != x else "")

    return _CLASS.sub(kinds, run)[:64]


def _label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in parts(whole):
            seen = sorted({x for t in batch.column("text").to_pylist() if t for x in labelled(t)})
            yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in seen], pa.bool_()), pa.array([shape(r) for _, r in seen], pa.string()), pa.array([r[: LONGEST + 1] for _, r in seen], pa.string())], ["secret", "shape", "run"])


def learn(docs: DataFrame, sample: int = SAMPLE) -> tuple[Automaton, Automaton]:
    """Automata of credentials and of other runs, from labelled runs of all texts.

    Distinct runs are found where they are and combined. Each task hands on EACH runs of a shape at most, then shapes are taken in
    turn, so a rare shape is learned beside the words that most runs are; `sample` runs of each label come to the driver.
    """
    runs = docs.select("text").mapInArrow(_label, "secret boolean, shape string, run string").distinct()
    # most runs are words, of one shape: the first of each share of a shape, then of all shares
    runs = runs.withColumn("share", F.pmod(F.xxhash64("run", F.lit(1)), F.lit(SHARES)))
    for by in (["secret", "shape", "share"], ["secret", "shape"]):
        runs = runs.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(F.xxhash64("run"), "run"))).filter(F.col("place") <= EACH)
    runs = written(runs, "runs")
    pick = lambda yes: [r.run for r in runs.filter(F.col("secret") == yes).orderBy("place", F.xxhash64("run"), "run").limit(sample).collect()]
    yes, no = pick(True), pick(False)
    dropped(runs)
    return taught(yes, no)


def taught(yes: list[str], no: list[str]) -> tuple[Automaton, Automaton]:
    """Automata of labelled runs. Not all that stands without a keyword is no credential: others that are likelier as credentials lose
    their label, and the automaton of the others is learned anew, ROUNDS times at most."""
    first = Automaton(sorted(yes), longest=LONGEST)
    no = sorted(no)
    for _ in range(ROUNDS):
        other = Automaton(no, longest=LONGEST)
        left = [r for r in no if first.score(r) <= other.score(r)] if yes else no
        if len(left) == len(no):
            break
        no = left
    else:
        other = Automaton(no, longest=LONGEST)
    return first, other


class Formats:
    """Both automata, and the scores of runs that were met."""

    def __init__(self, yes: Automaton, no: Automaton, margin: float = MARGIN) -> None:
        self.yes, self.no, self.margin = yes, no, margin
        self.known: dict[str, bool] = {}

    def likely(self, run: str) -> bool:
        if run not in self.known:
            if len(self.known) >= STORE:
                self.known.clear()
            self.known[run] = self.yes.score(run) - self.no.score(run) >= self.margin
        return self.known[run]


def all_spans(text: str, formats: Formats) -> list[tuple[int, int, int]]:
    """(start, kind, end) of base secrets, and of candidate runs that have the format of a credential. Every candidate is scored but
    those that a base span has as its whole."""
    base = [x[:3] for x in base_spans(text)]
    if not formats.yes.total[0]:
        return base
    known = {(a, b) for a, _, b in base}
    more = [(a, 3, b) for a, b in candidates(text) if (a, b) not in known and formats.likely(text[a:b])]
    inside = lambda a, b: any(x <= a and b <= y for x, _, y in base)
    return sorted(base + [x for x in more if not inside(x[0], x[2])])


def _named(spans: list[tuple[int, int, int]]) -> str:
    names = list(KINDS)
    return ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)


def scanned(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_format.

    Null and empty texts have no spans; repeated rows get a row each; whole texts are scanned, whatever their length; of runs of
    equal hash the lesser is learned from; columns other than doc_id and text are ignored. Without any labelled credential, so
    in an empty table, nothing is added to the base spans. A format span says that its run looks like the labelled credentials; one
    that lies in a base span isn't given again.
    """
    formats = Formats(*learn(docs, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole):
                rows = []
                for text in batch.column("text").to_pylist():
                    spans = all_spans(text or "", formats)
                    base = [x for x in spans if x[1] < 3]
                    n = [sum(x[1] == k for x in spans) for k in range(4)]
                    rows.append((*n[:3], hashlib.sha256(_named(base).encode()).hexdigest(), _named(spans), n[3]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x) for x in zip(*rows, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_format"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_format long")


def redacted(docs: DataFrame, sample: int = SAMPLE, mark: str = "[secret]") -> DataFrame:
    """docs with each run of overlapping secrets replaced by a mark; columns as they are, n_chars anew. Null texts stay null."""
    formats = Formats(*learn(docs, sample))

    def hide(text: str) -> str:
        out, at = [], 0
        for a, _, b in all_spans(text, formats):
            if a >= at:
                out += [text[at:a], mark]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole):
                texts = [None if t is None else hide(t) for t in batch.column("text").to_pylist()]
                new = {"text": pa.array(texts, pa.string()), "n_chars": pa.array([None if t is None else len(t) for t in texts], pa.int64())}
                yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in batch.schema.names], batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"))
