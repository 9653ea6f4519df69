"""Language-model scores of whole texts: a causal self-attention model over subword ids.

Text is lower-cased (A-Z) and split at ASCII white space; a word with a space before it is
encoded by a public byte-level BPE, which loses nothing, and an end id closes each document. The
model predicts the class of the next id and multiplies by the id's share of its class:

* classes and shares come from counts over all training documents: the SINGLES commonest ids
  are classes of their own, the others are grouped by the company they keep; classes stand in
  families of SLOTS, and a class's probability is its family's times its own within the family;
* a word's probability, given that a word begins, is a mixture: MIX of the probability of its
  first id's class in its context times the word's share of all words that begin in that class,
  and the rest of what the model gives to its ids one by one and to the word's ending there;
* the model reads the ids themselves, classes are its outputs only; it (embedding, one causal
  attention layer with learned relative biases, a feed-forward layer, softmax) is trained in
  numpy by Adam. First weights come from windows of TRAIN_DOCS training documents on the driver;
  from them every task trains on the whole texts of all its training documents, and the tasks'
  weights are averaged after each of ROUNDS parts.

A document is scored in blocks of BLOCK ids; each block attends to itself and the block before
it, so that windows of 2 * BLOCK overlap by half and every id is scored once. Blocks of many
documents go through one masked batch; a document's score does not depend on the others in it.

Texts are encoded once, into a written table of ids. The unigram base and the mixture need the
count of every word. The HEAD commonest words travel to the workers (bounded by that number);
each other word of a document is joined with the word counts, which no very common word takes
part in, and brings both sides of its mixture along, so that HEAD has no effect on a score.

Cases: a null or empty text is the end token alone; a null id counts as the empty text in the
fold; rows that repeat an id are scored each; without training rows N and V are 0; very long
texts and words are encoded whole; an empty table gives an empty result; only doc_id and text
are read, so other columns can't clash.
"""

from __future__ import annotations

import base64
import copy
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import as_strided
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import bpe as chunks
from millrace.llm import common

HELD_OUT = 1
HEAD = 120_000
#: Documents for the first weights only, so that tasks begin alike, and ids of a window of them.
TRAIN_DOCS = 700
TRAIN_IDS = 1024
#: Parts of the training documents after which the tasks' weights are averaged; each document is in one.
ROUNDS = 4
SINGLES = 96
GROUPS = 24
#: Commonest ids whose presence in a window is the company of the others.
NEIGHBOURS = 32
#: Classes of a family.
SLOTS = 12
#: Attention takes (1 + x / POWER) ** POWER for the exponential of x: never negative, and cheap. The code squares three times.
POWER = 8
DIM = 16
HIDDEN = 32
MIX = 0.75
BLOCK = 32
STEPS = 800
RATE = 0.01
#: Blocks of a step, and of a batch that is scored.
BATCH = 128
MOST = 128
#: Blocks whose attention is worked out together, so that it stays in a core's cache.
PART = 32
#: Tasks whose sums one task adds up.
FAN_IN = 64
#: Words, and bytes of words, that a task counts before it sends them on.
COUNTED, COUNTED_BYTES = 1_000_000, 64 << 20
VOCABULARY = "byte_bpe_50k.tiktoken"
IDS = 50_257
END = 50_256
_CODED = "uid long, doc_id long, held_out boolean, n_tokens long, head_log double, head_known long, ids binary, ranks binary, words array<string>"
_STATE = "uid long, doc_id long, held_out boolean, n_tokens long, head_log double, head_known long, score double, words array<string>, whole array<double>, spelled array<double>"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


_ENCODERS: dict = {}


def encoder(path: str):
    """The BPE of path, built once in each Python worker."""
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def opening_ids(path: str) -> np.ndarray:
    """Ids that begin a word (their bytes begin with a space), and the end id."""
    bpe = encoder(path)
    return np.array([i == END or bpe.decode_single_token_bytes(i)[:1] == b" " for i in range(IDS)])


def encoded(words: pa.Array, path: str, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of words, each with a space before it, and where each word's begin, the end last.

    Between white space a word's ids don't depend on its neighbours, so words go to the tokenizer together and are told
    apart by the ids that begin with a space (``opens``). Words that hold other white space could grow together: they go one by one.
    """
    bpe, odd = encoder(path), pc.match_substring_regex(words, chunks._SPACE).to_numpy(zero_copy_only=False)
    out, counts = [], np.zeros(len(words), np.int64)
    if not odd.all():
        ids = bpe.encode_to_numpy(" " + " ".join(words.filter(pa.array(~odd)).to_pylist())).astype(np.uint16)
        begin = np.flatnonzero(opens[ids])
        counts[~odd] = np.diff(begin, append=len(ids))
        out.append(ids)
    if not odd.any():
        return (np.concatenate(out) if out else np.zeros(0, np.uint16)), np.r_[0, np.cumsum(counts)]
    single = [np.array(bpe.encode_ordinary(" " + w), np.uint16) for w in words.filter(pa.array(odd)).to_pylist()]
    counts[odd] = [len(x) for x in single]
    order = np.argsort(np.r_[np.repeat(np.flatnonzero(~odd), counts[~odd]), np.repeat(np.flatnonzero(odd), counts[odd])], kind="stable")
    return np.concatenate([*out, *single])[order], np.r_[0, np.cumsum(counts)]


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of texts, the number of each occurrence's word, and where each text's occurrences begin."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = pc.if_else(pc.equal(lists.values, ""), None, lists.values).dictionary_encode()  # white space at an edge leaves an empty word
    index = coded.indices.fill_null(-1).to_numpy()
    kept = index >= 0
    return coded.dictionary, index[kept], np.r_[0, np.cumsum(kept)][lists.offsets.to_numpy()]


# --- the class model


class Model:
    """Weights of the class model, its classes and the ids' shares of them. Classes below ``opening`` begin a word."""

    NAMES = ("Q", "K", "V", "O", "B", "W1", "c1", "W2", "U", "S")

    def __init__(self, classes: int, rng, class_of: np.ndarray, log_share: np.ndarray, opening: int):
        own = np.arange(classes)
        before = -(-opening // SLOTS)  # families that begin a word
        self.family = np.where(own < opening, own // SLOTS, before + (own - opening) // SLOTS)
        self.slot = np.where(own < opening, own % SLOTS, (own - opening) % SLOTS)
        self.opening, n = before, int(self.family.max()) + 1
        self.gap = np.full((n, SLOTS), -1e9, np.float32)
        self.gap[self.family, self.slot] = 0
        self.shapes = {"Q": (DIM, DIM), "K": (DIM, DIM), "V": (DIM, DIM), "O": (DIM, DIM), "B": (BLOCK, 2 * BLOCK), "W1": (DIM, HIDDEN), "c1": (HIDDEN,), "W2": (HIDDEN, DIM), "U": (DIM + 1, n), "S": (n, DIM + 1, SLOTS)}
        ends = np.cumsum([int(np.prod(v)) for v in self.shapes.values()]).tolist()
        self.spans = [(k, a, z, v) for (k, v), a, z in zip(self.shapes.items(), [0, *ends], ends)]
        spread = {"B": 0, "c1": 0, "W2": 0.1, "U": 0.1, "S": 0.1}
        self.flat = np.concatenate([(rng.normal(0, 1, v) * spread.get(k, 1) / np.sqrt(v[-2] if len(v) > 1 else 1)).ravel() for k, v in self.shapes.items()]).astype(np.float32)
        self.E = rng.normal(0, 0.5, (IDS, DIM)).astype(np.float32)
        self.class_of, self.log_share = class_of, log_share
        self.mask = (np.arange(2 * BLOCK)[None] <= np.arange(BLOCK)[:, None] + BLOCK).astype(np.float32)

    def views(self, flat: np.ndarray) -> dict:
        """The weights by name, as views of a vector like ``flat``."""
        return {k: flat[a:z].reshape(shape) for k, a, z, shape in self.spans}

    def joined(self, w: dict) -> tuple[np.ndarray, np.ndarray]:
        """The products of the weights that act as one: of queries and keys, with what attention divides by, and of values and outputs."""
        return w["Q"] @ w["K"].T / np.asarray(POWER * np.sqrt(DIM), w["Q"].dtype), w["V"] @ w["O"]

    def queries(self) -> np.ndarray:
        """The query of each id, for a model that no longer changes."""
        return self.E @ self.joined(self.views(self.flat))[0]

    def attended(self, q: np.ndarray, kv: np.ndarray, first: np.ndarray, w: dict, kept: tuple | None) -> tuple[np.ndarray, np.ndarray]:
        """Sums of keys' weights times values, and of the weights, PART blocks at a time. kept: where the weights and what their gradient needs are left."""
        out, bias, keys = np.empty((len(q), BLOCK, DIM), q.dtype), 1 + w["B"] / POWER, kv.transpose(0, 2, 1)
        total, one = np.empty(len(q) * BLOCK, q.dtype), np.ones(2 * BLOCK, q.dtype)
        room, mask = np.empty((PART, BLOCK, 2 * BLOCK), q.dtype), self.mask.astype(q.dtype)
        for i in range(0, len(q), PART):
            own = slice(i, min(len(q), i + PART))
            u = np.matmul(q[own], keys[own], out=room[: own.stop - i])
            u += bias
            u *= mask
            u[first[own], :, :BLOCK] = 0
            if kept is None:
                e = u
                for _ in range(3):
                    e *= e
            else:
                e, u7 = (x[own] for x in kept)
                np.multiply(u, u, out=e)
                np.multiply(u, e, out=u7)
                e *= e
                u7 *= e
                e *= e
            np.matmul(e, kv[own], out=out[own])
            np.matmul(e.reshape(-1, 2 * BLOCK), one, out=total[i * BLOCK : own.stop * BLOCK])
        return out.reshape(-1, DIM), total[:, None]

    def forward(self, c: np.ndarray, first: np.ndarray, queries: np.ndarray | None = None) -> dict:
        """c: the input ids, in blocks; first: blocks that open a document; queries: of ``queries``, where no gradient is asked for. What stands before the output layer, row by row."""
        w, n = self.views(self.flat), len(c)
        c = c.ravel()
        qk, vo = self.joined(w)
        inputs = np.empty(((n + 1) * BLOCK, DIM), self.E.dtype)  # keys and values too; a block of nothing before the first
        inputs[:BLOCK] = 0
        x = self.E.take(c, 0, out=inputs[BLOCK:], mode="clip")
        a, b = inputs.strides
        kv = as_strided(inputs, (n, 2 * BLOCK, DIM), (BLOCK * a, a, b))
        q = (x @ qk if queries is None else queries.take(c, 0)).reshape(n, BLOCK, DIM)
        kept = np.empty((2, n, BLOCK, 2 * BLOCK), x.dtype) if queries is None else None
        a, total = self.attended(q, kv, first, w, kept)
        a /= total
        h = a @ vo
        h += x
        f = h @ w["W1"]
        f += w["c1"]
        np.maximum(f, np.zeros(1, f.dtype), out=f)
        z = f @ w["W2"]
        z += h
        return {"x": x, "q": q, "qk": qk, "vo": vo, "kv": kv, "kept": kept, "total": total, "a": a, "h": h, "f": f, "z": z, "w": w}

    def by_family(self, target: np.ndarray):
        """The family of each row's target, an order by it, and where each family's rows begin in that."""
        family = self.family.astype(np.uint8).take(target)
        order = np.argsort(family, kind="stable")
        return family, order, np.searchsorted(family.take(order), np.arange(len(self.gap) + 1)).tolist()

    def outputs(self, w: dict, z: np.ndarray, order: np.ndarray, cut: list[int]):
        """Shifted logits, one column a row of z: of the families, and in the order of families of the slots of the target's."""
        outer = w["U"][:DIM].T @ z.T
        outer += w["U"][DIM][:, None]
        outer -= outer.max(0)
        zs, inner = z.take(order, 0), np.empty((SLOTS, len(z)), z.dtype)
        own, bias = w["S"][:, :DIM].transpose(0, 2, 1), (w["S"][:, DIM] + self.gap)[:, :, None]
        for k, (a, b) in enumerate(zip(cut, cut[1:])):
            if a < b:
                part = inner[:, a:b]
                np.matmul(own[k], zs[a:b].T, out=part)
                part += bias[k]
        inner -= inner.max(0)
        return outer, inner, zs

    def log_probs(self, c, first, target, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Natural log-probability of each target class, and of any class that begins a word or ends the text."""
        got, target = self.forward(c, first, queries), target.ravel()
        family, order, cut = self.by_family(target)
        outer, inner, _ = self.outputs(got["w"], got["z"], order, cut)
        rows = np.arange(target.size)
        p, part = outer[family, rows], inner[self.slot.take(target.take(order)), rows]
        np.exp(outer, out=outer)
        opening = outer[: self.opening].sum(0) + np.float32(1e-35)
        whole = np.log(opening + outer[self.opening :].sum(0))
        p = (p - whole).astype(np.float64)
        p[order] += part - np.log(np.exp(inner, out=inner).sum(0))
        return p, np.log(opening) - whole

    def gradients(self, c, first, target, real) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Mean loss over real targets, ids that occur, the gradient of their rows of E, and that of ``flat``."""
        got, target, real = self.forward(c, first), target.ravel(), real.ravel()
        w, z, rows, n = got["w"], got["z"], np.arange(target.size), len(c)
        flat = np.zeros_like(self.flat)
        g = self.views(flat)
        weight = real * np.asarray(1 / max(1, int(np.count_nonzero(real))), z.dtype)
        family, order, cut = self.by_family(target)

        def loss_of(logits, hit, weight):
            """The loss; the logits become its gradient."""
            np.exp(logits, out=logits)
            whole, own = logits.sum(0), logits.reshape(-1)
            hit = hit * np.int64(len(rows)) + rows
            p = own.take(hit) / whole
            logits *= weight / whole
            own[hit] = (p - 1) * weight
            return -(np.log(np.maximum(p, 1e-30)) @ weight)

        outer, inner, zs = self.outputs(w, z, order, cut)
        loss = loss_of(outer, family, weight) + loss_of(inner, self.slot.take(target.take(order)), weight.take(order))
        np.matmul(z.T, outer.T, out=g["U"][:DIM])
        g["U"][DIM] = outer.sum(1)
        dz = outer.T @ w["U"][:DIM].T
        back, own = np.empty_like(dz), w["S"][:, :DIM].transpose(0, 2, 1)
        for k, (a, b) in enumerate(zip(cut, cut[1:])):
            if a < b:
                part = inner[:, a:b]
                np.matmul(zs[a:b].T, part.T, out=g["S"][k, :DIM])
                g["S"][k, DIM] = part.sum(1)
                np.matmul(part.T, own[k], out=back[a:b])
        place = np.empty_like(order)
        place[order] = rows
        dz += back.take(place, 0)
        np.matmul(got["f"].T, dz, out=g["W2"])
        df = dz @ w["W2"].T
        df *= got["f"] > 0
        np.matmul(got["h"].T, df, out=g["W1"])
        g["c1"][:] = np.ones(len(df), df.dtype) @ df
        dx = df @ w["W1"].T
        dx += dz
        a = got["a"]
        own = a.T @ dx
        g["V"][:], g["O"][:] = own @ w["O"].T, w["V"].T @ own
        # a is the quotient of the sums of e * x and of e
        da = dx @ got["vo"].T
        da /= got["total"]
        dq, keys = self.attention_gradients(got, da.reshape(n, BLOCK, DIM), np.einsum("ij,ij->i", da, a).reshape(n, BLOCK, 1), g["B"])
        own = got["x"].T @ dq / np.asarray(POWER * np.sqrt(DIM), a.dtype)
        g["Q"][:], g["K"][:] = own @ w["K"], own.T @ w["Q"]
        dx += dq @ got["qk"].T
        dx = dx.reshape(n, BLOCK, DIM)
        dx += keys[:, BLOCK:]
        dx[:-1] += keys[1:, :BLOCK]
        c = c.ravel().astype(np.uint16)
        order = np.argsort(c, kind="stable")
        c = c.take(order)
        begin = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        return float(loss), c[begin].astype(np.int64), np.add.reduceat(dx.reshape(-1, DIM).take(order, 0), begin, 0), flat

    @staticmethod
    def attention_gradients(got: dict, da: np.ndarray, less: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The gradients of queries, and of the inputs as keys and values of each block, PART blocks at a time; that of the bias is added to ``bias``. da, less: the gradient of the sums of ``attended``, and less that of the totals."""
        kv, (weights, u7), n = got["kv"], got["kept"], len(da)
        q, dq, keys = got["q"] * np.asarray(POWER, da.dtype), np.empty((n, BLOCK, DIM), da.dtype), np.empty((n, 2 * BLOCK, DIM), da.dtype)
        room, one, across = np.empty((PART, BLOCK, 2 * BLOCK), da.dtype), np.ones((1, PART), da.dtype), kv.transpose(0, 2, 1)
        for i in range(0, n, PART):
            own = slice(i, min(n, i + PART))
            d = np.matmul(da[own], across[own], out=room[: own.stop - i])
            d -= less[own]
            d *= u7[own]
            bias += (one[:, : len(d)] @ d.reshape(len(d), -1)).reshape(bias.shape)
            np.matmul(d, kv[own], out=dq[own])
            part = np.matmul(d.transpose(0, 2, 1), q[own], out=keys[own])
            part += weights[own].transpose(0, 2, 1) @ da[own]
        dq *= POWER
        return dq.reshape(-1, DIM), keys


def blocks(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Documents in blocks: inputs (the end id opens each), targets, which targets are real, which blocks open a document, and the places of ids in them."""
    n = -(-lengths // BLOCK)
    begins = np.cumsum(lengths) - lengths
    opens = np.cumsum(n) - n
    place = np.arange(len(ids)) + np.repeat(opens * BLOCK - begins, lengths)
    before, after, real = (np.full(int(n.sum()) * BLOCK, v) for v in (END, END, False))
    before[place[:-1] + 1] = ids[:-1]
    before[opens * BLOCK] = END
    after[place], real[place] = ids, True
    first = np.zeros(int(n.sum()), bool)
    first[opens] = True
    return before.reshape(-1, BLOCK), after.reshape(-1, BLOCK), real.reshape(-1, BLOCK), first, place


def commonest(counts: np.ndarray) -> np.ndarray:
    """All ids, the most frequent first."""
    return np.lexsort((np.arange(IDS), -counts))


def begun_model(counts: np.ndarray, opens: np.ndarray, company: np.ndarray, seed: int = 5) -> Model:
    """Classes, shares and untrained weights. counts: of every id in all training documents; opens: ids that begin a word; company: of ``Scorer._company``."""
    rng = np.random.default_rng(seed)
    class_of = np.empty(IDS, np.int64)
    order = commonest(counts)
    single = order[:SINGLES]
    at = 0
    for side in (True, False):  # classes that open a word come first
        mine = single[opens[single] == side]
        class_of[mine] = at + np.arange(len(mine))
        at += len(mine)
        rest = order[SINGLES:][opens[order[SINGLES:]] == side]
        class_of[rest] = at + _grouped(rest, counts, company[rest])
        at += GROUPS
        if side:
            opening = at
    smooth = counts + 0.5
    size = np.maximum(np.bincount(class_of, smooth, SINGLES + 2 * GROUPS), 1e-9)
    share = np.log(smooth / size[class_of])
    model = Model(SINGLES + 2 * GROUPS, rng, class_of, share, opening)
    w = model.views(model.flat)
    whole = np.bincount(model.family, size)
    w["U"][DIM] = np.log(whole / smooth.sum())
    w["S"][model.family, DIM, model.slot] = np.log(size / whole[model.family])
    return model


class Adam:
    def __init__(self, model: Model):
        self.model, self.step, self.times = model, 0, np.zeros(len(model.E), np.int64)
        self.dense = np.zeros((2, len(model.flat)), np.float32)
        self.rows = np.zeros((2, *model.E.shape), np.float32)

    def learn(self, before, after, real, first, rate: float) -> None:
        """One step over blocks of inputs, of targets, which targets are real, and which blocks open a document."""
        model = self.model
        self.step += 1
        _, own, rows, flat = model.gradients(before, first, model.class_of.take(after), real)
        rate *= min(1, self.step / 50)
        self.times[own] += 1  # rows of E have their own clocks
        for w, at, state, g, step in ((model.flat, ..., self.dense, flat, self.step), (model.E, own, self.rows, rows, self.times[own][:, None])):
            a, b = (x if at is ... else x.take(at, 0) for x in state)
            a = a + np.float32(0.1) * (g - a)
            b = b + np.float32(0.01) * (g * g - b)
            state[0][at], state[1][at] = a, b
            move = a * np.asarray(rate / (1 - 0.9**step), np.float32)
            move /= np.sqrt(b * np.asarray(1 / (1 - 0.99**step), np.float32)) + np.float32(1e-8)
            w[at] -= move

    def learn_all(self, documents: tuple, rate) -> None:
        """Steps of BATCH blocks over documents as ``blocks`` gives them; rate: of a step, given its number."""
        before, after, real, first, _ = documents
        for k, a in enumerate(range(0, len(before), BATCH)):
            lo = max(0, a - 1)  # the block before is context only
            own = real[lo : a + BATCH].copy()
            own[: a - lo] = False
            self.learn(before[lo : a + BATCH], after[lo : a + BATCH], own, first[lo : a + BATCH], rate(k))


def train(model: Model, documents: list[np.ndarray], steps: int | None = None, seed: int = 5) -> None:
    """First weights, from the ids of the sample."""
    steps = STEPS if steps is None else steps
    rng, adam = np.random.default_rng(seed), Adam(model)
    while documents and adam.step < steps:
        turn = [documents[i] for i in rng.permutation(len(documents))]
        done = adam.step
        adam.learn_all(blocks(np.concatenate(turn), np.array([*map(len, turn)])), lambda k: RATE * max(0.05, 1 - (done + k) / steps))


def train_whole(model: Model, parts, rate: float) -> tuple[int, np.ndarray]:
    """One pass over whole texts, by their ids and lengths; how many ids, and how often each row of E was an input."""
    adam, seen, used = Adam(model), 0, np.zeros(len(model.E), np.int64)
    for ids, lengths in parts:
        got = blocks(ids, lengths)
        seen += len(ids)
        used += np.bincount(got[0][got[2]], minlength=len(used))
        adam.learn_all(got, lambda k: rate)
    return seen, used


def weighed(model: Model, seen: int, used: np.ndarray) -> np.ndarray:
    """Weights for a sum over tasks: rows of E times their use, with the use; then all others times seen, with seen."""
    rest = np.append(model.flat, 1) * float(seen)
    rest = np.pad(rest, (0, -len(rest) % (DIM + 1))).reshape(-1, DIM + 1)
    return np.concatenate([np.c_[model.E * used[:, None], used], rest])


def averaged(model: Model, total: np.ndarray) -> None:
    """Take over the mean weights of a sum of ``weighed``; rows of E that no task used stay."""
    n, m = len(model.E), len(model.flat)
    used = total[:n, DIM]
    model.E[used > 0] = total[:n, :DIM][used > 0] / used[used > 0, None]
    rest = total[n:].ravel()
    if rest[m]:
        model.flat[:] = rest[:m] / rest[m]


def _grouped(rare: np.ndarray, counts: np.ndarray, company: np.ndarray) -> np.ndarray:
    """Groups of the rarer ids: by the company they keep in training (k-means over common neighbours), split by frequency."""
    size = company.sum(1, keepdims=True)
    company = np.sqrt(company / np.maximum(size, 1e-9))
    seen = np.flatnonzero(size[:, 0] > 0)
    kinds = 12
    label = np.full(len(rare), kinds - 1)
    if len(seen) >= kinds:
        centre = company[seen[np.linspace(0, len(seen) - 1, kinds - 1).astype(int)]]
        for _ in range(8):
            near = (company[seen] @ centre.T).argmax(1)
            for k in range(kinds - 1):
                if (near == k).any():
                    c = company[seen][near == k].mean(0)
                    centre[k] = c / max(1e-9, float(np.sqrt((c**2).sum())))
        label[seen] = near
    # each kind in parts of like frequency
    parts = GROUPS // kinds
    out = np.empty(len(rare), np.int64)
    for k in range(kinds):
        own = np.flatnonzero(label == k)
        total = np.cumsum(counts[rare[own]] + 0.5)
        out[own] = k * parts + (np.minimum(parts - 1, total * parts / total[-1]).astype(int) if len(own) else 0)
    return out


# --- corpus counts and scores


def _count(batches):
    """Words of training rows with their counts; what a task read is summed first."""
    held = []

    def flush(most: int):
        whole = pa.concat_tables(held).group_by("word").aggregate([("c", "sum")]).select(["word", "c_sum"]).rename_columns(["word", "c"]).combine_chunks()
        held[:] = [whole]
        if whole.num_rows > most or whole.nbytes > COUNTED_BYTES * (most > 0):
            yield from whole.to_batches(100_000)
            held.clear()

    for b in (part for whole in batches for part in chunks.slices(whole)):
        words, index, _ = words_of(b.column("text"))
        held.append(pa.table({"word": words, "c": np.bincount(index, minlength=len(words)).astype(np.int64)}))
        if sum(x.num_rows for x in held) > 2 * COUNTED or sum(x.nbytes for x in held) > 2 * COUNTED_BYTES:
            yield from flush(COUNTED)
    if held:
        yield from flush(-1)


def _documents(batches):
    """Ids of training rows of the written table, with their lengths."""
    for b in batches:
        raw = [r.as_buffer() for r in b.column("ids")]
        if raw:
            yield np.frombuffer(b"".join(raw), "<u2").astype(np.int64), np.array([r.size // 2 for r in raw])


class Scorer:
    """Counts over all training rows, and the model trained from them."""

    def __init__(self, docs: DataFrame, held_out: int = HELD_OUT, path: str | None = None):
        self.spark, self.path, self.held_out = docs.sparkSession, path or default_path(), held_out
        rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text", common.train_fold("doc_id", held_out).alias("held_out"))
        training = rows.where(~F.col("held_out"))
        self.counts = common.written(training.mapInArrow(_count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c")), self.spark)
        ends = training.count()
        n = self.counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
        self.tokens, self.distinct = (n.n or 0) + ends, n.v + (ends > 0)
        self.ends = ends
        top = self.counts.orderBy(F.desc("c"), "word").limit(HEAD).toArrow()
        self.head = top["word"].combine_chunks()
        self.head_counts = np.append(top["c"].to_numpy().astype(np.float64), ends)  # the end's rank is last
        counts, begun = self._id_counts()
        self.coded = self._coded(rows)
        training = self.coded.where(~F.col("held_out"))
        self.model = begun_model(counts, opening_ids(self.path), self._company(training, commonest(counts)[:NEIGHBOURS]))
        train(self.model, self._sample(training))
        self._train_all(training)
        self.begun = np.maximum(np.bincount(self.model.class_of, begun, SINGLES + 2 * GROUPS), 1)

    def _id_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of each id in all training rows, and of each as the first of a word, from the word counts."""
        path = self.path

        def run(batches):
            opens, total, begun = opening_ids(path), np.zeros(IDS, np.int64), np.zeros(IDS, np.int64)
            for b in batches:
                c = b.column("c").to_numpy()
                ids, begin = encoded(b.column("word"), path, opens)
                np.add.at(total, ids, np.repeat(c, np.diff(begin)))
                np.add.at(begun, ids[begin[:-1]], c)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at]), pa.array(begun[at])], names=["id", "c", "b"])

        out, first = np.zeros(IDS, np.int64), np.zeros(IDS, np.int64)
        for r in self.counts.mapInArrow(run, "id long, c long, b long").groupBy("id").agg(F.sum("c").alias("c"), F.sum("b").alias("b")).collect():  # at most IDS rows
            out[r.id], first[r.id] = r.c, r.b
        out[END] += self.ends
        first[END] += self.ends
        return out, first

    def _coded(self, rows: DataFrame) -> DataFrame:
        """The written table of all rows' ids (16 bits each, the end last), ranks of their words in the head, and words outside it."""
        path, ends = self.path, self.ends
        end_log, known_end = float(np.log10(ends + 0.5)), int(ends > 0)
        opens = opening_ids(path)
        held = self.spark.sparkContext.broadcast((self.head, self.head_counts, opens, encoded(self.head, path, opens)))  # HEAD words

        def run(batches):
            head, counts, opens, (known_ids, begin_known) = held.value
            logs, end, last = np.log10(counts + 0.5), np.array([END], "<u2").tobytes(), np.array([len(head)], "<i4").tobytes()
            for b in (part for whole in batches for part in chunks.slices(whole)):
                words, index, offsets = words_of(b.column("text"))
                place = pc.index_in(words, value_set=head.cast(words.type)).fill_null(-1).to_numpy()
                other_ids, begin = encoded(words.filter(pa.array(place < 0)), path, opens)
                pieces = np.r_[begin_known, begin_known[-1] + begin[1:]] * 2
                number = np.where(place < 0, len(head) + np.cumsum(place < 0) - 1, place)
                ids = chunks.taken(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(pieces) - 1, [None, pa.py_buffer(pieces), pa.py_buffer(np.r_[known_ids, other_ids])]), pa.array(number[index]), offsets)
                rank = place.astype(np.int32)[index]
                tail = rank < 0
                sums = np.r_[0, np.cumsum(np.where(tail, 0, logs[rank]))]
                known = np.r_[0, np.cumsum(~tail)]
                missed = words.take(pa.array(index[tail]))
                lists = pa.ListArray.from_arrays(pa.array((np.arange(len(index) + 1) - known)[offsets].astype(np.int32)), missed)
                raw = memoryview(rank.tobytes())
                yield pa.RecordBatch.from_arrays([
                    b.column("uid"), b.column("doc_id"), b.column("held_out"),
                    pa.array(np.diff(offsets).astype(np.int64) + 1), pa.array(np.diff(sums[offsets]) + end_log), pa.array(np.diff(known[offsets]) + known_end, pa.int64()),
                    pa.array([bytes(x) + end for x in ids], pa.binary()), pa.array([bytes(raw[4 * a : 4 * z]) + last for a, z in zip(offsets.tolist(), offsets[1:].tolist())], pa.binary()), lists,
                ], names=["uid", "doc_id", "held_out", "n_tokens", "head_log", "head_known", "ids", "ranks", "words"])

        return common.written(rows.mapInArrow(run, _CODED), self.spark)

    def _sample(self, training: DataFrame) -> list[np.ndarray]:
        """Ids of TRAIN_DOCS training rows for the first weights, windows of at most TRAIN_IDS."""
        chosen = training.select(F.xxhash64("doc_id", F.lit(3)).alias("h"), "uid").orderBy("h", "uid").limit(TRAIN_DOCS)
        n = F.length("ids") / 2  # the end id included
        begin = F.pmod(F.crc32(F.col("uid").cast("string").cast("binary")), F.greatest(F.lit(1), n - TRAIN_IDS + 1)).cast("int")
        window = F.substring("ids", 2 * begin + 1, F.lit(2 * TRAIN_IDS)).alias("ids")
        rows = training.select("uid", window).join(F.broadcast(chosen), "uid").orderBy("h", "uid").limit(TRAIN_DOCS).collect()  # at most TRAIN_DOCS windows
        return [np.frombuffer(r.ids, "<u2").astype(np.int64) for r in rows]

    def _summed(self, training: DataFrame, compute, shape: tuple[int, int]) -> np.ndarray:
        """The sum over tasks of the matrix that compute makes of a task's documents. Rows are dealt over tasks to be added up, FAN_IN matrices at a time."""
        slices = common.parts(self.spark)
        tasks = training._jdf.queryExecution().toRdd().getNumPartitions()

        def run(batches):
            matrix, own = compute(_documents(batches)), TaskContext.get().partitionId()
            at = np.flatnonzero(matrix.any(1))
            for k in range(slices):
                mine = at[at % slices == k]
                if len(mine):
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([own], pa.int32()), pa.array([mine.astype("<i4").tobytes()], pa.binary()), pa.array([matrix[mine].astype("<f8").tobytes()], pa.binary())], names=["slice", "task", "at", "rows"])

        def add(table: pa.Table) -> pa.Table:
            cells = sorted((r["task"], r["at"], r["rows"]) for r in table.to_pylist())
            own = np.unique(np.concatenate([np.frombuffer(a, "<i4") for _, a, _ in cells]))
            total = np.zeros((len(own), shape[1]))
            for _, a, rows in cells:
                total[np.searchsorted(own, np.frombuffer(a, "<i4"))] += np.frombuffer(rows, "<f8").reshape(-1, shape[1])
            return pa.table({"slice": table["slice"][:1], "task": pa.array([cells[0][0] // FAN_IN], pa.int32()), "at": pa.array([own.tobytes()], pa.binary()), "rows": pa.array([total.tobytes()], pa.binary())})

        kind = "slice int, task int, at binary, rows binary"
        sums = training.select("ids").mapInArrow(run, kind)
        while True:
            sums = sums.groupBy("slice", F.floor(F.col("task") / FAN_IN)).applyInArrow(add, kind)
            tasks = -(-tasks // FAN_IN)
            if tasks <= 1:
                break
        out = np.zeros(shape)
        for r in sums.collect():  # one matrix in all
            out[np.frombuffer(r["at"], "<i4")] = np.frombuffer(r["rows"]).reshape(-1, shape[1])
        return out

    def _company(self, training: DataFrame, single: np.ndarray) -> np.ndarray:
        """Of each id, the shares of the common ids in the windows that it occurs in, summed over all training rows."""
        slot = np.full(IDS, len(single))
        slot[single] = np.arange(len(single))

        def compute(parts):
            out = np.zeros((IDS, len(single)))
            for ids, lengths in parts:
                n = -(-lengths // TRAIN_IDS)
                begin = np.repeat(np.cumsum(lengths) - lengths, n) + TRAIN_IDS * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
                for a, z in zip(begin.tolist(), [*begin[1:].tolist(), len(ids)]):
                    w = ids[a:z]
                    near = np.bincount(slot[w], minlength=len(single) + 1)[:-1]
                    if size := near.sum():
                        out[np.unique(w)] += near / size
            return out

        return self._summed(training, compute, (IDS, len(single)))

    def _train_all(self, training: DataFrame) -> None:
        """Train on every training row, all of its text. Tasks begin each round with the same weights."""
        shape = weighed(self.model, 0, np.zeros(len(self.model.E), np.int64)).shape
        for turn in range(ROUNDS):
            held, rate = self.spark.sparkContext.broadcast(self.model), 0.3 * RATE * (1 - turn / ROUNDS)

            def compute(parts, held=held, rate=rate):
                model = copy.deepcopy(held.value)
                return weighed(model, *train_whole(model, parts, rate))

            averaged(self.model, self._summed(training.where(F.pmod(F.xxhash64("uid", F.lit(7)), F.lit(ROUNDS)) == turn), compute, shape))
            held.unpersist()

    def score(self) -> DataFrame:
        held = self.spark.sparkContext.broadcast((self.model, self.head_counts, self.begun, opening_ids(self.path)))  # of fixed sizes

        def run(batches):
            model, counts, begun, opens = held.value
            kinds = (pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64()), pa.list_(pa.float64()))
            for whole in batches:
                ends = np.cumsum([len(x.as_buffer()) for x in whole.column("ids")])
                cuts = np.searchsorted(ends, np.arange(0, int(ends[-1]) if len(ends) else 0, chunks.SLICE_BYTES), "left").tolist()
                for a, z in zip(cuts, [*cuts[1:], whole.num_rows]):
                    if a == z:
                        continue
                    b = whole.slice(a, z - a)
                    (ids, lengths), = _documents([b])
                    rank = np.frombuffer(b"".join(x.as_buffer() for x in b.column("ranks")), "<i4")
                    words = (b.column("n_tokens").to_numpy()).astype(np.int64)
                    p, opening = log_probs(model, ids, lengths)
                    score, both, tail = mixed(model, ids, opens, begun, p, opening, rank, counts)
                    begin = np.cumsum(words) - words
                    at = pa.array(np.r_[np.r_[0, np.cumsum(tail)][begin], tail.sum()].astype(np.int32))
                    lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in both]
                    yield pa.RecordBatch.from_arrays([*(b.column(k) for k in ("uid", "doc_id", "held_out", "n_tokens", "head_log", "head_known")), pa.array(np.add.reduceat(score, begin)), b.column("words"), *lists], names=["uid", "doc_id", "held_out", "n_tokens", "head_log", "head_known", "score", "words", "whole", "spelled"])

        state = common.written(self.coded.mapInArrow(run, _STATE), self.spark)
        common.discard(self.coded)
        tail = state.select("uid", F.explode(F.arrays_zip("words", "whole", "spelled")).alias("t")).select("uid", F.col("t.words").alias("word"), F.col("t.whole").alias("whole"), F.col("t.spelled").alias("spelled"))
        c = F.coalesce("c", F.lit(0))
        both = F.log10(F.lit(MIX) * F.col("whole") * c + F.lit(1 - MIX) * F.col("spelled") + F.lit(1e-300))
        tail = tail.join(self.counts, "word", "left").groupBy("uid").agg(F.sum(F.log10(c + 0.5)).alias("tail_log"), F.sum((c > 0).cast("long")).alias("tail_known"), F.sum(both).alias("tail_score"))
        norm = float(np.log10(self.tokens + 0.5 * (self.distinct + 1)))
        return state.drop("words", "whole", "spelled").join(tail, "uid", "left").select(
            "doc_id", "held_out", "n_tokens",
            (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).cast("long").alias("n_known"),
            F.lit(self.tokens).cast("long").alias("train_tokens"),
            (F.col("head_log") + F.coalesce("tail_log", F.lit(0.0)) - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
            (F.col("score") + F.coalesce("tail_score", F.lit(0.0))).alias("score"),
        )


def log_probs(model: Model, ids: np.ndarray, lengths: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Natural log-probability of the class of every id of documents, and of a word's beginning there; ``most`` blocks are scored together."""
    before, after, _, first, place = blocks(ids, lengths)
    most, p, opening, queries = most or MOST, np.empty(before.size), np.empty(before.size), model.queries()
    for a in range(0, len(before), most):
        lo = max(0, a - 1)  # the block before is context only
        got = model.log_probs(before[lo : a + most], first[lo : a + most], model.class_of.take(after[lo : a + most]), queries)
        for out, x in zip((p, opening), got):
            out[a * BLOCK : (a + most) * BLOCK] = x[(a - lo) * BLOCK :]
    return p[place], opening[place]


def mixed(model: Model, ids, opens, begun, p, opening, rank, counts) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """log10 probability of each word and end (0 outside the head); outside it the probability of the class by the words that begin in it, and that of the ids; which are outside.

    p, opening: of ``log_probs``; rank: of the words in the head, whose counts follow; begun: words that begin in each class.
    """
    cut = np.flatnonzero(opens[ids])
    begin = opening[cut]
    spelled = np.add.reduceat(p + model.log_share[ids], cut) - begin
    spelled += np.where(ids[cut] == END, 0, np.append(begin[1:], 0))  # the word ends there
    whole, spelled = np.exp(p[cut] - begin) / begun[model.class_of[ids[cut]]], np.exp(spelled)
    tail = rank < 0
    score = np.where(tail, 0, np.log10(MIX * whole * counts[rank] + (1 - MIX) * spelled + 1e-300))
    return score, [whole[tail], spelled[tail]], tail


def op7(spark, sf_dir: str) -> DataFrame:
    return Scorer(common.table(spark, sf_dir, "documents")).score()
