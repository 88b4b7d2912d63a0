"""Secret scans by a character convolutional network.

Candidates are all strings that could be a credential: runs of 12 or more key characters with both letters and digits, values
assigned to a name such as password or token, and private key blocks.  Each is read whole, with CONTEXT characters on either
side, by a small convolutional network in numpy: an embedding of (character, part), one convolution, maximum and mean over all
places, and a logistic output; long candidates are pooled piece by piece.  It is trained on labelled findings (labelled(), seeded: credentials of many formats, and
look-alikes such as checksums, identifiers, card numbers and URLs), its scores are calibrated on held-out findings (Platt), and
the threshold is the highest that still keeps RECALL of the held-out secrets, or one half if that is less.

The network and its threshold depend on no table and are the same everywhere.  All texts are scanned whole.

Defined cases: null and empty texts have no findings.  Findings never overlap: of two candidates that do, the one that starts
first, then the longer, is judged first, and the other if that one is no secret.  A name lies within the 32 characters before
its separator.  A key block without an end reaches to the end of the text.  Rows are independent; a repeated row repeats its
findings.  Offsets count characters.
"""

from __future__ import annotations

import base64
import functools
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, slices

CONTEXT, RECALL, FINDINGS, SEED = 24, 0.99, 6000, 7
REDACTED = "[SECRET]"

_RUN = re.compile(r"(?<![A-Za-z0-9+/_\-])[A-Za-z+/_\-]*[0-9][A-Za-z0-9+/_\-]*={0,2}")
_VALUE = re.compile(r"[:=][ \t]*[\"'`]?([^\s\"'`,;]{6,})")
_PARAMETER = re.compile(r"[^&#]{6,}")
_SEPARATOR = re.compile(r"[:=]")
_NAME = re.compile(r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_\-]?key|access[_\-]?key|auth\w*|credentials?|bearer)[\"'`\])]{0,2}[ \t]*$", re.I)
_BLOCK = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----.*?(?:-----END [A-Z ]*PRIVATE KEY-----|\Z)", re.S)


def _places(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of all that could be a credential, in order; some hold others, as a URL holds the token in it."""
    if not text:
        return []
    found = []
    for m in _RUN.finditer(text):
        a, b = m.span()
        if b - a >= 12 and not m[0].strip("+/_-=").isdigit() and any(map(str.isalpha, m[0])):
            found.append((a, b))
    # the name first, then its value: a value of no name, or of another one, may hold a named one
    for p in map(re.Match.start, _SEPARATOR.finditer(text)):
        if _NAME.search(text, max(0, p - 32), p) and (m := _VALUE.match(text, p)):
            found.append(m.span(1))
            # within a URL the value ends at the next parameter, in a password & and # are characters: both are judged
            if (cut := _PARAMETER.match(text, *m.span(1))) and cut.end() < m.end():
                found.append(cut.span())
    if "-----BEGIN " in text:
        found += [m.span() for m in _BLOCK.finditer(text)]
    return sorted(set(found), key=lambda x: (x[0], -x[1]))


def _apart(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in places:
        if not out or a >= out[-1][1]:
            out.append((a, b))
    return out


def candidates(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of every candidate that is judged first, in order, without overlaps."""
    return _apart(_places(text))


# --- labelled findings


def labelled(n: int = FINDINGS, seed: int = SEED, without: tuple[tuple[int, ...], tuple[int, ...]] = ((), ())) -> list[tuple[str, str, str, int]]:
    """(left context, candidate, right context, 1 if it is a secret), n of them, half of either kind.  without: numbers of the
    formats of look-alikes and of secrets that are left out, to be held against the network later."""
    r = np.random.default_rng(seed)

    def pick(xs):
        return xs[int(r.integers(len(xs)))]

    def chars(alphabet, k):
        return "".join(alphabet[i] for i in r.integers(len(alphabet), size=k))

    low, hexa, alnum = string.ascii_lowercase, "0123456789abcdef", string.ascii_letters + string.digits
    stems = "the er on in re th an ti es at ou he ing ion ent ge sch ich en ung que aux eau elle ment os as ado ar cion".split()

    def word():
        return "".join(pick(stems) for _ in range(int(r.integers(1, 4))))

    def prose(k):
        return " ".join(word() + pick(["", "", "", ",", "."]) for _ in range(k))

    def b64(k):
        return base64.b64encode(r.bytes(k)).decode()

    secret_formats = [
        lambda: (pick(["password", "passwd", "pwd", "PASSWORD", "db_password", "secret"]) + pick(["=", ": ", "=\"", " = "]), chars(hexa, int(r.integers(10, 33))), pick(["", "\"", " "])),
        lambda: (pick(["password", "passwd", "pwd", "secret"]) + pick(["=", ": ", "='", " = "]), chars(alnum + "!#$%&*@", int(r.integers(8, 24))), pick(["", "'", " "])),
        lambda: (pick(["password", "pwd"]) + pick(["=", ": "]), word() + pick(["", "_", "!"]) + chars(string.digits, int(r.integers(2, 5))), ""),
        lambda: (pick(["token", "api_key", "auth_token", "access_token", "apikey", "secret_key", "TOKEN"]) + pick([" = \"", "=\"", ": \"", "=", ": "]), chars(pick([hexa, hexa, alnum, alnum + "_-"]), int(pick([32, 40, 40, 48, 64, int(r.integers(20, 65))]))), pick(["\"", "", "\";"])),
        lambda: (pick(["token", "api_key", "auth_token", "secret", "secret_key", "password", "TOKEN"]) + pick([" = ", "=", ": "]) + pick(["\"", "\"", "'"]), chars(hexa, int(pick([32, 40, 40, 64]))), pick(["\"", "\"", "'"])),
        lambda: (pick(["token", "api key", "key", "access token"]) + pick([" = \"", "=\"", ": ", " "]), chars(hexa, int(pick([32, 40, 40, 64]))), pick(["\"", ""])),
        lambda: (pick(["aws_access_key_id=", "key ", "", "export AWS_ACCESS_KEY_ID="]), "AKIA" + chars(string.ascii_uppercase + string.digits, 16), ""),
        lambda: (pick(["aws_secret_access_key=", "secret: ", "AWS_SECRET_ACCESS_KEY=\""]), b64(30), pick(["", "\""])),
        lambda: (pick(["", "token ", "use "]), pick(["ghp_", "gho_", "sk_live_", "sk-", "xoxb-", "glpat-", "npm_", "hf_"]) + chars(alnum, int(r.integers(20, 40))), ""),
        lambda: (pick(["Authorization: Bearer ", "bearer ", "jwt="]), "eyJ" + chars(alnum, 17) + pick(["", "_", "-"]) + chars(alnum + "_-", int(r.integers(20, 90))), ""),
        lambda: (pick(["https://", "http://", "GET /", "see https://www."]) + word() + pick([".io/", ".com/", ".example.org/", "/"]) + word() + pick(["?", "?", "?id=1&", "?u=" + word() + "&"]) + pick(["token", "api_key", "access_token", "auth", "secret", "password", "pwd"]) + "=", chars(pick([hexa, alnum, alnum, alnum + "!$%*@"]), int(r.integers(6, 33))), pick(["", "", "&" + word() + "=1", "&lang=en", "#" + word()])),
        lambda: ("", "-----BEGIN " + pick(["RSA ", "EC ", "OPENSSH ", ""]) + "PRIVATE KEY-----\n" + b64(int(r.integers(60, 300))) + "\n-----END PRIVATE KEY-----", ""),
    ]
    plain_formats = [
        lambda: (pick(["commit ", "at revision ", "git show ", "merged "]), chars(hexa, 40), ""),
        lambda: (pick(["sha256:", "md5 ", "checksum ", "digest=", "etag: \"", "sha1 = "]), chars(hexa, int(pick([32, 40, 64]))), pick(["", "\""])),
        lambda: (pick(["id ", "uuid=", "request ", "trace_id: ", "session "]), "-".join(chars(hexa, k) for k in (8, 4, 4, 4, 12)), ""),
        lambda: (pick(["https://example.com/", "see www.example.org/", "path /", "/usr/lib/"]), "/".join(word() for _ in range(3)) + "/" + chars(string.digits, int(r.integers(1, 6))), ""),
        lambda: (pick(["", "file ", "open "]), "_".join(word() for _ in range(int(r.integers(2, 5)))) + "_" + chars(string.digits, int(r.integers(1, 5))), pick(["", ".txt", ".py"])),
        lambda: (pick(["", "the ", "model "]), pick(["covid", "version", "release", "figure", "isotope", "highway", "chapter"]) + "-" + word() + "-" + chars(string.digits, int(r.integers(1, 5))), ""),
        lambda: (pick(["card ", "", "no. ", "isbn "]), chars(string.digits, int(pick([13, 16]))) + pick(["x", "X", "-a"]), ""),
        lambda: (pick(["", "on ", "at "]), f"20{chars(string.digits, 2)}-0{chars('123456789', 1)}-1{chars(string.digits, 1)}T1{chars('0123456789', 1)}", ":00:00"),
        lambda: (pick(["password: ", "secret = ", "token: ", "Token = "]), pick(["required", "optional", "forgotten", "changed", "none_given", "string", "<your-password>", "${PASSWORD}", "os.environ", "********", "xxxxxxxx", "expired", "field", "invalid"]), ""),
        lambda: (pick(["<img src=\"data:image/png;base64,", "url(data:font/woff2;base64,"]), b64(int(r.integers(30, 90))), "\""),
        lambda: (pick(["color=", "width=", "class=\"", "v="]), word() + chars(string.digits, int(r.integers(1, 5))) + word() + word(), pick(["", "\""])),
        lambda: (pick(["call ", "", "phone "]), "+1-" + chars(string.digits, 3) + "-555-" + chars(string.digits, 4) + "ext" + chars(string.digits, 2), ""),
        lambda: (pick(["", "the ", prose(1) + " "]), word() + word() + word() + chars(string.digits, int(r.integers(1, 4))), pick(["", "."])),
    ]
    used = [[f for k, f in enumerate(formats) if k not in out] for formats, out in zip((plain_formats, secret_formats), without)]
    out = []
    for i in range(n):
        left, mid, right = pick(used[i % 2])()
        before, after = pick(["", prose(6) + pick([" ", "\n", ". "])]), pick(["", " " + prose(5), "\n" + prose(5)])
        out.append(((before + left)[-CONTEXT:], mid, (right + after)[:CONTEXT], i % 2))
    return out


# --- the network

_CODES = 102  # padding, 95 printable characters, line feed, other space, capital letter, small letter, other digit, anything else


@functools.lru_cache(4096)
def _code(c: str) -> int:
    if " " <= c <= "~":
        return ord(c) - 31
    return 96 if c == "\n" else 97 if c.isspace() else 98 if c.isupper() else 99 if c.isalpha() else 100 if c.isdigit() else 101


def _codes(text: str) -> np.ndarray:
    points, place = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
    return np.array([_code(chr(p)) for p in points.tolist()], np.int16)[place]


def _rows(findings: list[tuple[str, str, str]]) -> list[np.ndarray]:
    """Numbers of (part, character): left context, candidate, right context."""
    return [np.concatenate([_codes(part) + np.int16(k * _CODES) for k, part in enumerate(f) if part] or [np.zeros(0, np.int16)]) for f in findings]


#: Places (rows times their padded length) that the network reads at once, some 100 MB; longer candidates come in pieces.
PLACES = 1 << 16


class Network:
    WIDTH, SIZE, FILTERS = 5, 12, 32

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.p = [r.normal(0, 0.3, (3 * _CODES, self.SIZE)), r.normal(0, (self.WIDTH * self.SIZE) ** -0.5, (self.WIDTH * self.SIZE, self.FILTERS)), np.zeros(self.FILTERS), r.normal(0, 0.1, 2 * self.FILTERS), np.zeros(1)]
        self.slope, self.offset, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, ids: np.ndarray, real: np.ndarray):
        """ids, real: (rows, places); places beyond a row's end aren't real."""
        e, w, b, v, c = self.p
        x = e[ids] * real[..., None]
        pad = self.WIDTH // 2
        wide = np.pad(x, ((0, 0), (pad, pad), (0, 0)))
        cols = np.concatenate([wide[:, k : k + ids.shape[1]] for k in range(self.WIDTH)], 2)
        h = np.maximum(cols @ w + b, 0) * real[..., None]
        n = real.sum(1, keepdims=True)
        pooled = np.concatenate([h.max(1), h.sum(1) / n], 1)
        return cols, h, n, pooled, pooled @ v + c[0]

    def raw(self, rows: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(rows))
        order = sorted(range(len(rows)), key=lambda i: len(rows[i]))
        at = 0
        while at < len(order):
            # rows of about one length together, and no more than PLACES of them
            long = len(rows[order[at]])
            if long > PLACES:
                out[order[at]] = self._piecewise(rows[order[at]])
                at += 1
                continue
            end = at
            while end < len(order) and end - at < 256 and (n := len(rows[order[end]])) <= 1.25 * long + 8 and (end == at or (end + 1 - at) * n <= PLACES):
                end += 1
            some = [rows[i] for i in order[at:end]]
            out[order[at:end]] = self._forward(*_padded(some))[-1]
            at = end
        return out

    def _piecewise(self, row: np.ndarray) -> float:
        """The same for one long row: maximum and sum over its pieces, each read with its neighbours."""
        top, total, pad = np.zeros(self.FILTERS), np.zeros(self.FILTERS), self.WIDTH // 2
        for a in range(0, len(row), PLACES):
            low, b = max(0, a - pad), min(len(row), a + PLACES)
            h = self._forward(*_padded([row[low : b + pad]]))[1][0, a - low : b - low]
            top, total = np.maximum(top, h.max(0)), total + h.sum(0)
        return float(np.concatenate([top, total / len(row)]) @ self.p[3] + self.p[4][0])

    def scores(self, findings: list[tuple[str, str, str]]) -> np.ndarray:
        """Calibrated probabilities that the findings are secrets."""
        return 1 / (1 + np.exp(-(self.slope * self.raw(_rows(findings)) + self.offset))) if findings else np.zeros(0)

    def train(self, findings: list[tuple[str, str, str, int]], rounds: int = 9, batch: int = 50, seed: int = SEED) -> Network:
        r = np.random.default_rng(seed)
        held = r.random(len(findings)) < 0.25
        fit, rest = [f for f, h in zip(findings, held) if not h], [f for f, h in zip(findings, held) if h]
        rows, y = _rows([f[:3] for f in fit]), np.array([f[3] for f in fit], float)
        by_length = np.array(sorted(range(len(rows)), key=lambda i: len(rows[i])))
        groups = np.array_split(by_length, max(1, len(rows) // batch))
        m, s, step = [0.0] * 5, [0.0] * 5, 0
        for _ in range(rounds):
            for g in r.permutation(len(groups)):
                pick = groups[g]
                ids, real = _padded([rows[i] for i in pick])
                cols, h, n, pooled, z = self._forward(ids, real)
                dz = (1 / (1 + np.exp(-z)) - y[pick]) / len(pick)
                e, w, _, v, _ = self.p
                dp = dz[:, None] * v
                dh = np.repeat((dp[:, self.FILTERS :] / n)[:, None], ids.shape[1], 1)
                top = h.argmax(1)
                np.add.at(dh, (np.arange(len(pick))[:, None], top, np.arange(self.FILTERS)), dp[:, : self.FILTERS])
                dh = dh * (h > 0)
                dcols = dh @ w.T
                de, pad = np.zeros_like(e), self.WIDTH // 2
                dwide = np.zeros((len(pick), ids.shape[1] + 2 * pad, self.SIZE))
                for k in range(self.WIDTH):
                    dwide[:, k : k + ids.shape[1]] += dcols[..., k * self.SIZE : (k + 1) * self.SIZE]
                np.add.at(de, ids, dwide[:, pad : pad + ids.shape[1]] * real[..., None])
                slopes = [de, np.einsum("rpi,rpf->if", cols, dh, optimize=True), dh.sum((0, 1)), pooled.T @ dz, dz.sum(keepdims=True)]
                step += 1
                for i, d in enumerate(slopes):
                    m[i], s[i] = 0.9 * m[i] + 0.1 * d, 0.999 * s[i] + 0.001 * d**2
                    self.p[i] = self.p[i] - 0.004 * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.999**step)) + 1e-8)
        self._calibrate(rest)
        return self

    def _calibrate(self, held: list[tuple[str, str, str, int]]) -> None:
        """Platt scaling, then the highest threshold that keeps RECALL of the held-out secrets."""
        z, y = self.raw(_rows([f[:3] for f in held])), np.array([f[3] for f in held], float)
        a, b = 1.0, 0.0
        for _ in range(200):
            p = 1 / (1 + np.exp(-(a * z + b)))
            a, b = a - 0.05 * (((p - y) * z).mean() + 0.01 * (a - 1)), b - 0.05 * (p - y).mean()
        self.slope, self.offset = float(a), float(b)
        secret = np.sort((1 / (1 + np.exp(-(a * z + b))))[y == 1])
        self.threshold = float(min(0.5, secret[int((1 - RECALL) * len(secret))]))


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    length = np.array([len(r) for r in rows])
    ids = np.zeros((len(rows), max(1, length.max())), np.int64)
    for i, r in enumerate(rows):
        ids[i, : len(r)] = r
    return ids, (np.arange(ids.shape[1]) < np.maximum(length, 1)[:, None]).astype(float)


@functools.lru_cache(2)
def network(n: int = FINDINGS, seed: int = SEED) -> Network:
    return Network(seed).train(labelled(n, seed))


def findings(texts: list[str | None], net: Network) -> list[list[tuple[int, int, float]]]:
    """(start, end, score) of the secrets of each text."""
    left = [_places(text) for text in texts]
    out: list[list[tuple[int, int, float]]] = [[] for _ in texts]
    while any(left):
        spans = [(i, a, b) for i, places in enumerate(left) for a, b in _apart(places)]
        scores = net.scores([(texts[i][max(0, a - CONTEXT) : a], texts[i][a:b], texts[i][b : b + CONTEXT]) for i, a, b in spans])
        judged: list[dict[tuple[int, int], bool]] = [{} for _ in texts]
        for (i, a, b), s in zip(spans, scores.tolist()):
            judged[i][a, b] = s >= net.threshold
            if judged[i][a, b]:
                out[i].append((a, b, s))
        # what only overlaps refused ones is judged next
        left = [_beside([x for x in places if x not in done], [x for x, secret in done.items() if secret]) for places, done in zip(left, judged)]
    return [sorted(found) for found in out]


def _beside(places: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those of places that overlap none of taken; both are in order, and taken are apart."""
    out, k = [], 0
    for a, b in places:
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if k == len(taken) or b <= taken[k][0]:
            out.append((a, b))
    return out


def redact(text: str, spans: list[tuple[int, int, float]]) -> str:
    for a, b, _ in reversed(spans):
        text = text[:a] + REDACTED + text[b:]
    return text


def secret_scan(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, start, end, masked, score), one for each secret: its place, its first characters, and the network's score."""
    net = network()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = [(d, a, b, text[a : a + 3] + "***", s) for d, text, found in zip(part["doc_id"], part["text"], findings(part["text"], net)) for a, b, s in found]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["doc_id", "start", "end", "masked", "score"])

    return lean(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, start int, end int, masked string, score double")


def redact_secrets(docs: DataFrame) -> DataFrame:
    """docs with every secret replaced by REDACTED; n_chars, if there, follows the text.  No row is dropped."""
    net, names = network(), docs.columns
    place, count = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(place).to_pylist()
                found = findings(texts, net)
                if any(found):
                    columns = list(part.columns)
                    columns[place] = pa.array([redact(t, f) if f else t for t, f in zip(texts, found)], part.schema.field(place).type)
                    if count is not None:
                        old = part.column(count).to_pylist()
                        columns[count] = pa.array([len(redact(t, f)) if f else n for t, f, n in zip(texts, found, old)], part.schema.field(count).type)
                    part = pa.RecordBatch.from_arrays(columns, schema=part.schema)
                yield part

    return lean(docs).mapInArrow(run, docs.schema)
