"""Full-text search: tokens, boolean queries, rank and phrases, as Spark SQL over arrays.

A text's tokens are its maximal runs of letters and digits, in lower case, numbered from 1.  A text vector is an array of
(term, positions, weight).  Queries known when the statement is bound become plain expressions; queries that are columns are
parsed by row, in Arrow batches.
"""

from __future__ import annotations

import re
from array import array

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from ..errors import BindError
from .text import let, quoted

TOKEN = "([\\p{IsAlphabetic}\\p{N}]+)"
WEIGHTS = {"A": 40, "B": 30, "C": 20, "D": 10}


def _word(c: str) -> bool:
    return c.isalnum()


def parse_query(text: str) -> tuple:
    """("term", t), ("not", q), ("and", a, b) or ("or", a, b); | binds weakest, then &, then !."""
    tokens, at = [], 0
    while at < len(text):
        c = text[at]
        if c.isspace():
            at += 1
        elif c in "|&!()":
            tokens.append(c)
            at += 1
        elif _word(c):
            end = at
            while end < len(text) and _word(text[end]):
                end += 1
            tokens.append("=" + text[at:end].lower())
            at = end
        else:
            raise BindError(f"unexpected {c!r} in a text query")
    tokens.append("")
    i = 0

    def chain(op: str, mark: str, below):
        nonlocal i
        left = below()
        while tokens[i] == mark:
            i += 1
            left = (op, left, below())
        return left

    def unary():
        nonlocal i
        t = tokens[i]
        i += 1
        if t == "!":
            return ("not", unary())
        if t == "(":
            inner = disjunction()
            if tokens[i] != ")":
                raise BindError("a text query lacks )")
            i += 1
            return inner
        if t.startswith("="):
            return ("term", t[1:])
        raise BindError("a text query lacks a term")

    def disjunction():
        return chain("or", "|", lambda: chain("and", "&", unary))

    out = disjunction()
    if tokens[i]:
        raise BindError("a text query lacks an operator between terms")
    return out


def positive_terms(q: tuple, positive: bool = True) -> list[str]:
    """The distinct terms that are not below a negation, in order."""
    if q[0] == "term":
        return [q[1]] if positive else []
    if q[0] == "not":
        return positive_terms(q[1], not positive)
    return list(dict.fromkeys(t for x in q[1:] for t in positive_terms(x, positive)))


def tokens(text: str) -> str:
    return f"transform(regexp_extract_all({text}, {quoted(TOKEN)}, 1), w -> lower(w))"


def vector(text: str) -> str:
    """The text vector of a text: its terms in order, their positions, weight D."""
    return f"mw_text_vector({text})"


def _condition(q: tuple, has) -> str:
    if q[0] == "term":
        return has(q[1])
    if q[0] == "not":
        return f"(NOT {_condition(q[1], has)})"
    return f"({_condition(q[1], has)} {q[0].upper()} {_condition(q[2], has)})"


def _possible(q: tuple, positive: bool = True) -> str | None:
    """A condition on d, the text in lower case, that every matching text meets; None if there is none.  It spares most texts
    the tokenizer.  Only terms of ASCII take part, whose lower case doesn't depend on what stands around them."""
    if q[0] == "term":
        return f"contains(d, {quoted(q[1])})" if positive and q[1].isascii() else None
    if q[0] == "not":
        return _possible(q[1], not positive)
    both = [x for x in (_possible(q[1], positive), _possible(q[2], positive)) if x]
    if (q[0] == "and") == positive:
        return f"({' AND '.join(both)})" if both else None
    return f"({' OR '.join(both)})" if len(both) == 2 else None


def _tokenized(doc: str, possible: str | None, body: str, otherwise: str) -> str:
    """body over k, the tokens of the text; otherwise for texts that can't match, NULL for a null text."""
    full = let(tokens(doc), "k", f"CASE WHEN k IS NOT NULL THEN {body} END")
    if possible is None:
        return full
    return f"CASE WHEN {doc} IS NULL THEN NULL WHEN {let(f'lower({doc})', 'd', possible)} THEN {full} ELSE {otherwise} END"


def matches(doc: str, is_vector: bool, query: str) -> str:
    """Whether the document matches; NULL for a null document."""
    q = parse_query(query)
    if is_vector:
        return let(doc, "k", f"CASE WHEN k IS NOT NULL THEN {_condition(q, lambda t: f'exists(k, e -> e.term = {quoted(t)})')} END")
    return _tokenized(doc, _possible(q), _condition(q, lambda t: f"array_contains(k, {quoted(t)})"), "false")


def rank(doc: str, is_vector: bool, query: str) -> str:
    """NULL if the document doesn't match, else the sum over its positive terms of 16 - min(first position, 16), the weight, and
    twice the occurrences."""
    q = parse_query(query)
    if is_vector:
        weight = "CASE e.weight " + " ".join(f"WHEN '{w}' THEN {n}" for w, n in WEIGHTS.items()) + " ELSE 0 END"

        def score(t):
            return f"coalesce(try_element_at(transform(filter(k, e -> e.term = {quoted(t)}), e -> 16 - least(array_min(e.positions), 16) + {weight} + 2 * size(e.positions)), 1), 0)"

        has = lambda t: f"exists(k, e -> e.term = {quoted(t)})"
    else:

        def score(t):
            return f"if(array_contains(k, {quoted(t)}), 26 - least(array_position(k, {quoted(t)}), 16) + 2 * size(filter(k, w -> w = {quoted(t)})), 0)"

        has = lambda t: f"array_contains(k, {quoted(t)})"
    total = " + ".join(f"CAST({score(t)} AS BIGINT)" for t in positive_terms(q)) or "0L"
    if is_vector:
        return let(doc, "k", f"CASE WHEN k IS NOT NULL AND {_condition(q, has)} THEN {total} END")
    return _tokenized(doc, _possible(q), f"CASE WHEN {_condition(q, has)} THEN {total} END", "CAST(NULL AS BIGINT)")


def phrase_terms(phrase: str) -> list[str]:
    out = []
    for word in phrase.split():
        term = "".join(c for c in word if _word(c)).lower()
        if not term:
            raise BindError("a phrase has a word without letters or digits")
        out.append(term)
    if not out:
        raise BindError("a phrase is empty")
    return out


#: Up to this gap the places after a term are listed and met with those of the next, which is linear in the text.
SMALL_GAP = 16


def phrase(doc: str, is_vector: bool, text: str, gap: int) -> str:
    """Whether the terms follow one another, each at most gap places after the last.  The places where a part of the phrase can
    end are carried from term to term."""
    if gap < 1:
        raise BindError("the gap of a phrase is at least 1")

    def places(t):
        if is_vector:
            return f"coalesce(try_element_at(transform(filter(k, e -> e.term = {quoted(t)}), e -> e.positions), 1), array())"
        return f"filter(transform(k, (w, i) -> if(w = {quoted(t)}, i + 1, NULL)), p -> p IS NOT NULL)"

    terms = phrase_terms(text)
    ends = places(terms[0])
    for n, t in enumerate(terms[1:]):
        if gap <= SMALL_GAP:
            ends = f"array_intersect(flatten(transform({ends}, q -> sequence(q + 1, q + {gap}))), {places(t)})"
        else:
            ends = let(ends, f"f{n}", f"filter({places(t)}, p -> exists(f{n}, q -> p > q AND p <= q + {gap}))")
    if is_vector:
        return let(doc, "k", f"CASE WHEN k IS NOT NULL THEN size({ends}) > 0 END")
    q = ("term", terms[0])
    for t in terms[1:]:
        q = ("and", q, ("term", t))
    return _tokenized(doc, _possible(q), f"{_condition(q, lambda t: f'array_contains(k, {quoted(t)})')} AND size({ends}) > 0", "false")


# --- queries and phrases that are columns

_RUNS = re.compile(r"[^\W_]+")


def _tokens(text: str) -> list[str]:
    return [t.lower() for t in _RUNS.findall(text)]


def _holds(q: tuple, terms: set) -> bool:
    if q[0] == "term":
        return q[1] in terms
    if q[0] == "not":
        return not _holds(q[1], terms)
    a, b = _holds(q[1], terms), _holds(q[2], terms)
    return (a or b) if q[0] == "or" else (a and b)


def _match(doc, query):
    if query is None:
        raise ValueError("a text query is NULL")
    return None if doc is None else _holds(parse_query(query), set(_tokens(doc)))


def _rank(doc, query):
    if doc is None or query is None:
        return None
    k, q = _tokens(doc), parse_query(query)
    if not _holds(q, set(k)):
        return None
    return sum(26 - min(k.index(t) + 1, 16) + 2 * k.count(t) for t in positive_terms(q) if t in k)


def _phrase(doc, text, gap):
    if doc is None or text is None or gap is None:
        return None
    if gap < 1:
        raise ValueError("the gap of a phrase is at least 1")
    k, terms = _tokens(doc), phrase_terms(text)
    ends = {i for i, w in enumerate(k) if w == terms[0]}
    for t in terms[1:]:
        ends = {i for i, w in enumerate(k) if w == t and any(i - gap <= e < i for e in ends)}
    return bool(ends)


def text_vector(text: str | None, stop_words: frozenset[str] = frozenset(), stem=None) -> list[dict] | None:
    """Terms with their positions; stop words are left out but keep their places, and a stemmer maps tokens to terms."""
    if text is None:
        return None
    return [{"term": t, "positions": p.tolist(), "weight": "D"} for t, p in _places(text, stop_words, stem)]


def _places(text: str, stop_words: frozenset[str] = frozenset(), stem=None) -> list[tuple[str, array]]:
    """The terms in order, each with its positions."""
    places: dict[str, array] = {}
    for i, m in enumerate(_RUNS.finditer(text), 1):
        t = m[0].lower()
        if t not in stop_words:
            t = stem(t) if stem else t
            held = places.get(t)
            if held is None:
                held = places[t] = array("i")
            held.append(i)
    return sorted(places.items())


def text_vectors(texts: pa.Array) -> pa.Array:
    """The vectors of a batch of texts.  They go into Arrow's own buffers text by text, so that beside these no more than one
    text's terms are held as Python objects."""
    chars, chars_to, places, places_to, terms_to, known = bytearray(), array("i", [0]), array("i"), array("i", [0]), array("i", [0]), bytearray()
    for x in texts:
        text = x.as_py()
        known.append(text is not None)
        for t, p in _places(text or ""):
            chars += t.encode()
            chars_to.append(len(chars))
            places.extend(p)
            places_to.append(len(places))
        terms_to.append(len(chars_to) - 1)
    held = lambda a: pa.py_buffer(a) if len(a) else pa.py_buffer(b"")
    ints = lambda a: pa.Array.from_buffers(pa.int32(), len(a), [None, held(a)])
    n = len(chars_to) - 1
    terms = pa.Array.from_buffers(pa.string(), n, [None, held(chars_to), held(chars)])
    positions = pa.ListArray.from_arrays(ints(places_to), ints(places))
    entries = pa.StructArray.from_arrays([terms, positions, pa.repeat("D", n)], ["term", "positions", "weight"])
    null = pa.Array.from_buffers(pa.uint8(), len(known), [None, held(known)]).cast(pa.bool_())
    return pa.ListArray.from_arrays(ints(terms_to), entries, mask=pc.invert(null))


def register(spark) -> None:
    """The functions that work by row: text vectors, and queries that are columns."""
    from pyspark.sql.functions import arrow_udf, pandas_udf

    spark.udf.register("mw_text_vector", arrow_udf(text_vectors, "array<struct<term: string, positions: array<int>, weight: string>>"))

    def each(f, *columns):
        return pd.Series([f(*(None if x is pd.NA or x is None or x != x else x for x in row)) for row in zip(*columns)], dtype=object)

    def match(doc: pd.Series, query: pd.Series) -> pd.Series:
        return each(_match, doc, query)

    def ranked(doc: pd.Series, query: pd.Series) -> pd.Series:
        return each(_rank, doc, query)

    def phrased(doc: pd.Series, text: pd.Series, gap: pd.Series) -> pd.Series:
        return each(_phrase, doc, text, gap)

    spark.udf.register("mw_text_matches", pandas_udf(match, "boolean"))
    spark.udf.register("mw_text_rank", pandas_udf(ranked, "long"))
    spark.udf.register("mw_text_phrase", pandas_udf(phrased, "boolean"))
