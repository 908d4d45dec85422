"""Personal data: exact patterns, and a skip-chain conditional random field beside them.

The field labels words as other, as one of the four kinds of the patterns, as a secret or as a
name. Its nodes are the words with a digit or an at sign, the capitalised ones, and the words
next to those with evidence (a digit, an at sign or a cue such as "contact" or "token"); a text
without any evidence has none. Neighbouring nodes share transition potentials, and each node
shares one with the next node of the same or of a similar word (equal but for its digits),
however distant. Labels are inferred by loopy sum-product message passing, with the words of
the patterns' spans held to their kind, so a word that shows nothing of itself follows what its
repetitions are: a name that is announced once is found wherever it comes again. All
weights, that of the skip edges as well, are learned by likelihood, with the same messages, from a bounded sample
of documents, whose labels are the spans of the patterns, words that a cue announces, and
repetitions of such words.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelark.llm._common import release, texts

KINDS = ["email", "ip", "card", "phone", "secret", "name"]
SECRET, NAME, LABELS = 4, 5, 7
TRAINING_DOCS, TRAINING_NODES, TRAINING_CHARS, STEPS, ROUNDS = 2000, 20_000, 50_000, 300, 20
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARKS = re.compile(r"[0-9@]")
# Words that announce a name, in the supported languages, and words that announce a secret.
NAME_CUES = frozenset("contact dear mr mrs ms dr sincerely monsieur madame mme contactez herr frau kontakt señor señora contacto attn".split())
SECRET_CUES = frozenset("token secret password passwd pwd api_key apikey api-key access_key".split())
#: Short cues count as evidence at the beginning of a word, long ones anywhere.
_SHORT = sorted(c for c in NAME_CUES | SECRET_CUES if len(c) <= 4)
_LONG = sorted(c for c in NAME_CUES | SECRET_CUES if len(c) > 4)
_EVIDENCE = "[0-9@]|(?:^|[ \n\t])(?:" + "|".join(_SHORT) + ")|" + "|".join(map(re.escape, _LONG))
_ASSIGNED = re.compile(r"(?i)(?<![^\W_])(?:" + "|".join(sorted(map(re.escape, SECRET_CUES), key=lambda w: (-len(w), w))) + r")[\x20]*[=:][\x20]*[\"']?([A-Za-z0-9+/_-]{12,})")
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EDGE = ".,;:!?\"'()[]{}|$&*#%=<>"
_N_TESTS = 27


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans of the patterns as (start, kind, end), in order."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append((start, 0, end))
        at = text.find("@", at + 1 if not m else max(end, at + 1))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for w in [*"0123456789@", *_LONG, *(x + c for c in _SHORT for x in " \n\t")]:
        found.add_word(w, True)
    found.make_automaton()
    return found


_AUTOMATON = _automaton()


def evident(text: str) -> bool:
    """A digit, an at sign or a cue, in one pass; _EVIDENCE says the same as a pattern."""
    return next(_AUTOMATON.iter(" " + text.lower()), None) is not None


def _tests(w: str) -> int:
    """What holds of a word, as bits."""
    digits = sum("0" <= c <= "9" for c in w)
    core = w.strip(_EDGE)
    low = core.lower()
    letters = any(c.isalpha() for c in w)
    mixed = digits > 0 and letters and core.isalnum()
    checks = [
        "@" in w,
        "@" in w and "." in w.partition("@")[2],
        core.count(".") == 3,
        "." in core,
        "+" in w,
        "(" in w or ")" in w,
        "-" in core,
        digits == 0,
        0 < digits <= 3,
        4 <= digits <= 7,
        8 <= digits <= 13,
        14 <= digits <= 19,
        digits > 19,
        digits > 0 and digits == len(core),
        letters,
        '"' in w,
        "=" in w or w.endswith(":"),
        mixed,
        14 <= digits <= 19 and digits == len(core) and _luhn(core) if core.isascii() else False,
        core[:1].isupper() and not core[1:].isupper(),
        len(core) > 1 and core.isupper(),
        low in NAME_CUES,
        low in SECRET_CUES,
        mixed and len(core) >= 16,
        mixed and len(core) >= 32,
        w[-1:] in ".!?",
        w[-1:] in ",;:",
    ]
    return sum(bool(c) << i for i, c in enumerate(checks))


def seed_spans(text: str, words: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Spans (start, kind, end) that a cue announces: a value given to a secret, up to three capitalised words after a name's cue."""
    out = [(m.start(1), SECRET, m.end(1)) for m in _ASSIGNED.finditer(text)]
    for i, (a, b) in enumerate(words):
        if text[a:b].strip(_EDGE).lower() not in NAME_CUES or text[b - 1] in "!?":
            continue
        for x, y in words[i + 1 : i + 4]:
            if not _capital(text[x:y]):
                break
            out.append((x, NAME, y))
            if text[y - 1] in _EDGE:
                break
    return sorted(out)


def _capital(w: str) -> bool:
    core = w.strip(_EDGE)
    return len(core) > 1 and core[0].isupper() and core.lower() not in NAME_CUES


def _labels(spans: list[tuple[int, int, int]], words: list[tuple[int, int]]) -> list[int]:
    """Of each word the kind (from 1) of the first span that it meets, or 0; words and spans are in order."""
    out, at = [], 0
    for a, b in words:
        while at < len(spans) and spans[at][2] <= a:
            at += 1
        out.append(next((k + 1 for s, k, e in spans[at : at + 4] if s < b and e > a), 0))
    return out


#: Numbers kept of a node: start, end, tests of the word and of the words before and after, index of the
#: word, label for training, next alike (a node or -1), and the label that a pattern's span holds it to (or 0).
WIDTH = 9


def field_nodes(text: str, base: list[tuple[int, int, int]]) -> list[list[int]]:
    """The nodes of a text."""
    words = [(m.start(), m.end()) for m in _WORDS.finditer(text)]
    tests = [_tests(text[a:b]) for a, b in words]
    cue = 1 << 21 | 1 << 22
    marked = [bool(_MARKS.search(text, a, b)) for a, b in words]
    evidence = [m or bool(t & cue) for m, t in zip(marked, tests, strict=True)]
    capital = [_capital(text[a:b]) for a, b in words]
    use = [i for i in range(len(words)) if evidence[i] or capital[i] or (i and evidence[i - 1]) or (i + 1 < len(words) and evidence[i + 1])]
    held, seeds = _labels(sorted(base), words), _labels(seed_spans(text, words), words)
    label = [h or s for h, s in zip(held, seeds, strict=True)]
    told = {text[a:b].strip(_EDGE): n for (a, b), n in zip(words, seeds, strict=True) if n}
    nodes, last = [], {}
    for n, i in enumerate(use):
        a, b = words[i]
        core = text[a:b].strip(_EDGE)
        nodes.append([a, b, tests[i], tests[i - 1] if i else 0, tests[i + 1] if i + 1 < len(words) else 0, i, label[i] or told.get(core, 0), -1, held[i]])
        if marked[i] or capital[i]:
            shape = re.sub("[0-9]", "0", core.lower())
            if shape in last:
                nodes[last[shape]][7] = n
            last[shape] = n
    return nodes


def _features(nodes: np.ndarray) -> np.ndarray:
    bits = [(nodes[:, c, None] >> np.arange(_N_TESTS)) & 1 for c in (2, 3, 4)]
    return np.concatenate([*bits, np.ones((len(nodes), 1), np.int64)], axis=1).astype(np.float32)


def _links(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chain edges (between neighbouring words) and skip edges, as pairs of nodes."""
    i = np.flatnonzero(nodes[1:, 5] == nodes[:-1, 5] + 1)
    s = np.flatnonzero(nodes[:, 7] >= 0)
    return np.stack([i, i + 1], axis=1), np.stack([s, nodes[s, 7]], axis=1)


def _directed(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """Source and target of each message, the message that runs the other way, and how many edges there are of each kind."""
    chain, skip = _links(nodes)
    src = np.concatenate([chain[:, 0], chain[:, 1], skip[:, 0], skip[:, 1]])
    dst = np.concatenate([chain[:, 1], chain[:, 0], skip[:, 1], skip[:, 0]])
    n_c, n_s = len(chain), len(skip)
    back = np.concatenate([np.arange(n_c) + n_c, np.arange(n_c), 2 * n_c + n_s + np.arange(n_s), 2 * n_c + np.arange(n_s)])
    return src, dst, back, n_c, n_s


def _gather(unary: np.ndarray, dst: np.ndarray, msg: np.ndarray) -> np.ndarray:
    """What each node hears, with what it shows itself."""
    flat = dst[:, None] * LABELS + np.arange(LABELS)
    return unary + np.bincount(flat.ravel(), weights=msg.ravel(), minlength=unary.size).reshape(unary.shape)


def _pass(total: np.ndarray, msg: np.ndarray, edges: tuple, model: dict[str, np.ndarray]) -> np.ndarray:
    """One round of sum-product messages, each of greatest value 0."""
    src, _, back, n_c, n_s = edges
    z = total[src] - msg[back]
    z -= z.max(axis=1, keepdims=True)
    e = np.exp(z)
    forth, still = np.exp(model["t"]), np.exp(model["s"][0])
    # an edge between alike words multiplies by 1, and by more where both labels are equal
    out = np.concatenate([e[:n_c] @ forth, e[n_c : 2 * n_c] @ forth.T, e[2 * n_c :].sum(axis=1, keepdims=True) + (still - 1) * e[2 * n_c :]])
    new = np.log(np.maximum(out, 1e-300))
    return new - new.max(axis=1, keepdims=True)


def _normal(z: np.ndarray, axis: int | tuple[int, ...] = 1) -> np.ndarray:
    p = np.exp(z - z.max(axis=axis, keepdims=True))
    return p / p.sum(axis=axis, keepdims=True)


def train(sample: list[np.ndarray], steps: int = STEPS) -> dict[str, np.ndarray]:
    """Weights w (features x labels), t (label before x label after), s (bonus of equal labels).

    The gradient of the likelihood is what the labels show less what the field expects, in the
    beliefs of nodes and of edges; messages go on from step to step, two rounds in each.
    """
    model = {"w": np.zeros((3 * _N_TESTS + 1, LABELS)), "t": np.zeros((LABELS, LABELS)), "s": np.zeros(1)}
    if not sample:
        return model
    at = np.cumsum([0, *(len(n) for n in sample)])
    every = joined_nodes(sample)
    x, one, n = _features(every), np.eye(LABELS)[every[:, 6]], at[-1]
    edges = src, dst, back, n_c, n_s = _directed(every)
    chain, skip = slice(0, n_c), slice(2 * n_c, 2 * n_c + n_s)
    seen_t, seen_s = one[src[chain]].T @ one[dst[chain]], (every[src[skip], 6] == every[dst[skip], 6]).sum()
    msg = np.zeros((len(src), LABELS))
    speed = {k: np.full(v.shape, 1e-8) for k, v in model.items()}
    for _ in range(steps):
        unary = x @ model["w"]
        for _ in range(2):
            msg = 0.5 * msg + 0.5 * _pass(_gather(unary, dst, msg), msg, edges, model)
        total = _gather(unary, dst, msg)
        rest = total[src] - msg[back]  # what each source says but for this edge
        pair = _normal(rest[chain][:, :, None] + model["t"] + rest[n_c : 2 * n_c][:, None, :], (1, 2)).sum(axis=0) if n_c else 0.0
        both = _normal(rest[skip][:, :, None] + np.eye(LABELS) * model["s"] + rest[2 * n_c + n_s :][:, None, :], (1, 2)) if n_s else np.zeros((0, LABELS, LABELS))
        grads = {"w": x.T @ (one - _normal(total)) / n, "t": (seen_t - pair) / n, "s": np.array([(seen_s - np.trace(both, axis1=1, axis2=2).sum()) / n])}
        for k, v in grads.items():
            v = v - 1e-5 * model[k]
            speed[k] += v * v
            model[k] += 0.3 * v / np.sqrt(speed[k])
    return model


def joined_nodes(parts: list[np.ndarray]) -> np.ndarray:
    """The nodes of several texts as one table; words of two texts are never neighbours."""
    start = np.cumsum([0, *(len(p) for p in parts)])
    every, of = np.concatenate(parts), np.repeat(np.arange(len(parts)), np.diff(start))
    every[:, 7] = np.where(every[:, 7] >= 0, every[:, 7] + start[of], -1)
    every[:, 5] += 2 * of << 32
    return every


def beliefs(nodes: np.ndarray, model: dict[str, np.ndarray], rounds: int = ROUNDS) -> np.ndarray:
    """Label probabilities of each node by loopy sum-product message passing; nodes that a pattern holds keep their label."""
    unary = _features(nodes) @ model["w"]
    fixed = np.flatnonzero(nodes[:, 8])
    unary[fixed] = -30.0
    unary[fixed, nodes[fixed, 8]] = 0.0
    edges = _directed(nodes)
    dst, msg = edges[1], np.zeros((len(edges[1]), LABELS))
    for _ in range(rounds if len(dst) else 0):
        new = _pass(_gather(unary, dst, msg), msg, edges, model)
        moved = np.abs(new - msg).max()
        msg = 0.5 * msg + 0.5 * new if moved > 1e-4 else new
        if moved <= 1e-4:
            break
    return _normal(_gather(unary, dst, msg))


def added_spans(nodes: np.ndarray, label: np.ndarray, edges: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of labelled nodes that no base span overlaps; neighbouring words of one label join. edges: of each word without punctuation.

    Spans of kinds other than names have a digit or an at sign.
    """
    out: list[list[int]] = []
    for n in np.flatnonzero(label):
        a, b = edges[n]
        if a >= b or any(s < b and e > a for s, _, e in base):
            continue
        kind = int(label[n]) - 1
        if out and out[-1][1] == kind and nodes[n, 5] == nodes[out[-1][3], 5] + 1:
            out[-1][2:] = [b, n]
        else:
            out.append([a, kind, b, n])
    has = lambda s, e: any((nodes[n, 2] & 1) or not (nodes[n, 2] >> 7 & 1) for n in np.flatnonzero((nodes[:, 0] < e) & (nodes[:, 1] > s)))
    return [(s, k, e) for s, k, e, _ in out if k == NAME or has(s, e)]


_FOUND = "doc_id long, base array<int>, nodes array<int>, edges array<int>"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        base, nodes, edges = [], [], []
        for t in b.column(1):
            text = t.as_py()
            spans: list[tuple[int, int, int]] = []
            own: list[list[int]] = []
            if evident(text):
                spans = base_spans(text)
                own = field_nodes(text, spans)
            base.append([x for s in spans for x in s])
            nodes.append([x for n in own for x in n])
            cut = []
            for n in own:
                w = text[n[0] : n[1]]
                a = n[0] + len(w) - len(w.lstrip(_EDGE))
                cut += [a, max(a, n[0] + len(w.rstrip(_EDGE)))]
            edges.append(cut)
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.list_(pa.int32())) for x in (base, nodes, edges))], names=["doc_id", "base", "nodes", "edges"])


def find_personal_data(docs: DataFrame, training_docs: int = TRAINING_DOCS, training_nodes: int = TRAINING_NODES, training_chars: int = TRAINING_CHARS) -> DataFrame:
    """Base spans and all spans of every whole text.

    docs: doc_id, text; other columns are left aside. A null or empty text has no spans,
    repeated rows are searched one by one, and an empty table gives an empty result. The
    weights are learned from ``training_docs`` texts with evidence at most, chosen by a hash:
    whole ones, of not more than ``training_chars`` characters each and ``training_nodes`` nodes
    altogether. Everything is searched and labelled. Without any such text nothing is added.

    Returns doc_id, base and spans (arrays of struct<start, kind, end>, code points, end
    exclusive; base kinds are the first four of KINDS).
    """
    model = _learn(docs, training_docs, training_nodes, training_chars)
    item = "array<struct<start:int,kind:int,end:int>>"
    return texts(docs).mapInArrow(_labelled(model), f"doc_id long, base {item}, spans {item}")


def _learn(docs: DataFrame, training_docs: int, training_nodes: int, training_chars: int) -> dict[str, np.ndarray] | None:
    marked = texts(docs).withColumn("h", F.xxhash64("doc_id", "text"))
    fits = (F.char_length("text") <= training_chars) & F.lower("text").rlike(_EVIDENCE)
    last = marked.where(fits).select("h").distinct().orderBy("h").limit(training_docs).agg(F.max("h")).first()[0]
    if last is None:
        return None
    chosen = marked.where(F.col("h") <= last).where(fits).groupBy("h").agg(F.first("text").alias("text"))  # equal rows are one
    found = chosen.select(F.col("h").alias("doc_id"), "text").mapInArrow(_find, _FOUND).select("nodes").where(F.size("nodes") > 0)
    sample, held = [], 0
    for nodes in sorted(r["nodes"] for r in found.collect()):  # bounded: training_docs texts of training_chars
        if held + len(nodes) // WIDTH <= training_nodes:
            sample.append(np.array(nodes, np.int64).reshape(-1, WIDTH))
            held += len(sample[-1])
    return train(sample) if sample else None


def _all_spans(base: list[list[int]], nodes: list[list[int]], edges: list[list[int]], model: dict[str, np.ndarray] | None, most: int = 100_000) -> Iterator[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """Base spans and all spans of some texts; messages of some ``most`` nodes, of whole texts, pass at once."""
    own = [np.array(n, np.int64).reshape(-1, WIDTH) for n in nodes]
    at = 0
    while at < len(own):
        to, size = at + 1, len(own[at])
        while to < len(own) and size + len(own[to]) <= most:
            size += len(own[to])
            to += 1
        start = np.cumsum([0, *(len(n) for n in own[at:to])])
        label = np.zeros(size, np.int64)
        if model and size:
            label = beliefs(joined_nodes(own[at:to]), model).argmax(axis=1)
        for i in range(at, to):
            fixed = [tuple(base[i][j : j + 3]) for j in range(0, len(base[i]), 3)]
            mine = label[start[i - at] : start[i - at + 1]]
            more = added_spans(own[i], mine, list(zip(edges[i][::2], edges[i][1::2], strict=True)), fixed) if mine.any() else []
            yield fixed, sorted(fixed + more)
        at = to


def _labelled(model: dict[str, np.ndarray] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _find(batches):
            base, spans = [], []
            for fixed, every in _all_spans(*(b.column(i).to_pylist() for i in (1, 2, 3)), model):
                base.append([dict(zip(("start", "kind", "end"), s, strict=True)) for s in fixed])
                spans.append([dict(zip(("start", "kind", "end"), s, strict=True)) for s in every])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, kind), pa.array(spans, kind)], names=["doc_id", "base", "spans"])
        release()

    return label


def mask_personal_data(docs: DataFrame, training_docs: int = TRAINING_DOCS, training_nodes: int = TRAINING_NODES, training_chars: int = TRAINING_CHARS) -> DataFrame:
    """docs, all columns and rows, with each span of ``text`` replaced by its kind in brackets; null stays null.

    Weights and cases as in find_personal_data. Texts are searched where they stand, so no text
    is shuffled.
    """
    model = _learn(docs, training_docs, training_nodes, training_chars)
    at = docs.columns.index("text")

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(at)
            blank = pa.array([None] * b.num_rows, pa.int64())
            out = []
            for found in _find(iter([pa.RecordBatch.from_arrays([blank, text.fill_null("")], names=["doc_id", "text"])])):
                for t, (_, spans) in zip(text, _all_spans(*(found.column(i).to_pylist() for i in (1, 2, 3)), model), strict=True):
                    out.append(masked(t.as_py(), spans) if spans else t.as_py())
            yield b.set_column(at, b.schema.field(at), pa.array(out, text.type))
        release()

    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # names with dots or in two cases do no harm
    return plain.mapInArrow(mask, plain.schema).toDF(*docs.columns)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def span_text(spans: str) -> F.Column:
    """Spans as kind:start:end, comma-joined."""
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def base_digest(base: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(joined(base).encode()).hexdigest()
