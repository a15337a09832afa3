"""A batch of JSON texts read at once: one structural pass over all their bytes, then paths, edits and keep lists by positions.

Array operations find the strings, brackets, colons and commas of every text and which container each lies in. Texts that this pass finds
well formed are worked on many at a time; all others, and what is not provided here, are left to the functions for single texts, with the same
results.
"""

from __future__ import annotations

import numpy as np

from docweave.functions import rawjson as J
from docweave.plans import keep as K

_NONE = -1


def _table(signs: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(signs)] = True
    return out


_SPACE, _STRUCTURE = _table(b" \t\n\r"), _table(b"{}[]:,")
_BEGINS = _table(b'"-0123456789tfn')
_ODD = ~_table(bytes(range(0x20, 0x7F)) + b"\t\n\r")
_OBJECT, _ARRAY, _OBJECT_END, _ARRAY_END, _COLON, _COMMA = b"{[}]:,"


class Batch:
    """The structure of some texts. Tokens are the brackets, colons and commas outside strings, in order.

    ok: which texts are well formed; all else is defined for these alone. begin, end: where each text lies in data; at, sign, doc: place,
    kind and text of each token; inside: token that opens the container a token lies in (for a bracket, that it opens or closes itself);
    close: of an opening token the closing one; keys: by colon token, where its key begins and ends within its quotes, and whether it has escapes.
    """

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        self.raw = b"\n".join(texts) + b"\n"
        data = self.data = np.frombuffer(self.raw, np.uint8)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.begin = np.cumsum(sizes + 1) - sizes - 1
        self.end = self.begin + sizes
        n = len(texts)
        bad = np.zeros(n, dtype=bool)
        text_of = np.repeat(np.arange(n), sizes + 1)  # of each byte
        doc_of = text_of.__getitem__

        quotes = np.flatnonzero(data == 34)
        slashes = data == 92
        if slashes.any():
            solid = np.maximum.accumulate(np.where(slashes, 0, np.arange(1, len(data) + 1)))  # one past the last byte that is no backslash
            before = np.where(quotes > 0, quotes - solid[quotes - 1], 0)
            quotes = quotes[before % 2 == 0]
        by_doc = np.bincount(doc_of(quotes), minlength=n)
        bad |= by_doc % 2 == 1
        quotes = quotes[~bad[doc_of(quotes)]]
        self.quotes = quotes

        string = np.zeros(len(data) + 1, np.int8)
        string[quotes[::2]] = 1
        string[quotes[1::2] + 1] -= 1
        string = np.cumsum(string[:-1], dtype=np.int8).astype(bool)
        at = np.flatnonzero(_STRUCTURE[data] & ~string)
        doc = doc_of(at)
        keep = ~bad[doc]
        at, doc = at[keep], doc[keep]
        sign = data[at]
        opens, closes = (sign == _OBJECT) | (sign == _ARRAY), (sign == _OBJECT_END) | (sign == _ARRAY_END)
        after = np.cumsum(opens.astype(np.int64) - closes)
        first = np.searchsorted(doc, np.arange(n))  # first token of each text
        base = np.where(first > 0, after[first - 1], 0) if len(at) else np.zeros(n, np.int64)
        after -= base[doc]
        self.depth = after
        level = after + closes
        bad |= np.bincount(doc[(level < 1)], minlength=n) > 0
        last = np.searchsorted(doc, np.arange(n), side="right") - 1
        has = last >= first
        bad[has] |= after[last[has]] != 0
        # by text, level and place: each container's tokens stand together
        order = np.lexsort((at, level, doc))
        o_open, o_sign, o_doc = opens[order], sign[order], doc[order]
        opener = np.maximum.accumulate(np.where(o_open, np.arange(len(order)), 0))
        head = o_sign[opener] if len(order) else o_sign
        inside = np.empty(len(order), np.int64)
        inside[order] = order[opener] if len(order) else opener
        lost = (doc[inside] != doc) | (level[inside] != level)  # in ill-formed texts
        inside[lost] = np.flatnonzero(lost)
        wrong = np.where(head == _OBJECT, o_sign == _ARRAY_END, (o_sign == _OBJECT_END) | (o_sign == _COLON))
        if len(order):
            prev, cur = o_sign[:-1], o_sign[1:]
            same = (o_doc[1:] == o_doc[:-1]) & (level[order][1:] == level[order][:-1])
            begins = np.concatenate([[True], ~same])
            wrong |= begins & ~o_open
            starts_again = np.concatenate([[False], same & ((prev == _OBJECT_END) | (prev == _ARRAY_END))])
            wrong |= starts_again != (o_open & ~begins)
            in_object = head[1:] == _OBJECT
            wrong[1:] |= same & in_object & (cur == _COMMA) & (prev != _COLON)
            wrong[1:] |= same & in_object & (cur == _COLON) & (prev != _OBJECT) & (prev != _COMMA)
            wrong[1:] |= same & in_object & (cur == _OBJECT_END) & (prev == _COMMA)
        bad |= np.bincount(o_doc[wrong], minlength=n) > 0
        self.close = np.full(len(at), _NONE)
        ends = np.flatnonzero(closes)
        self.close[inside[ends]] = ends
        self.order, self.place = order, np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))

        # what lies between tokens: runs of bytes that are no white space, or lie in strings
        filled = string | ~_SPACE[data]
        filled[at] = False
        edge = np.diff(np.concatenate([[False], filled, [False]]).view(np.int8))
        self.run_begin, self.run_end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        run_doc = doc_of(self.run_begin)
        mark = np.zeros(len(data) + 1, np.int32)
        mark[quotes + 1] = 1
        mark = np.cumsum(mark, dtype=np.int32)
        quoted = mark[self.run_end] - mark[self.run_begin]
        whole_string = (quoted == 2) & (data[self.run_begin] == 34) & (data[self.run_end - 1] == 34)
        run_bad = ~_BEGINS[data[self.run_begin]] | ~(whole_string | (quoted == 0))
        odd = np.flatnonzero(_ODD[data] & ~string)
        bad[doc_of(odd)] = True
        bad[run_doc[run_bad]] = True
        self.is_string = whole_string
        # each gap after a token, and before the first one of a text, holds what the tokens around it call for
        mark[:] = 0
        mark[at + 1] = 1
        run_token = np.cumsum(mark, dtype=np.int64)[self.run_begin] - 1  # the token before, of whatever text
        within = (run_token >= 0) & (doc[run_token] == run_doc) if len(at) else np.zeros(len(run_token), dtype=bool)
        runs = np.bincount(run_token[within], minlength=len(at))
        heading = np.bincount(run_doc[~within], minlength=n)
        bad |= heading > ~has  # a scalar alone, or nothing before the first token
        bad |= ~has & (heading != 1)
        bad[has] |= ~opens[np.minimum(first, max(0, len(at) - 1))][has] if len(at) else False
        if len(at):
            tail = np.append(doc[1:] != doc[:-1], True)
            then = np.append(sign[1:], 0)
            then_open = np.append(opens[1:], False)
            kind = sign[inside]
            value = (sign == _COLON) | (sign == _ARRAY) | ((sign == _COMMA) & (kind == _ARRAY))
            key = (sign == _OBJECT) | ((sign == _COMMA) & (kind == _OBJECT))
            empty = ((sign == _ARRAY) & (then == _ARRAY_END)) | ((sign == _OBJECT) & (then == _OBJECT_END))
            want = np.where(closes | tail, 0, np.where(value & then_open, 0, 1))
            gap_bad = (runs != want) & ~(empty & (runs == 0))
            gap_bad |= key & (then != _COLON) & ~empty
            gap_bad |= (sign == _OBJECT) & empty & (runs == 1)
            gap_bad |= closes & then_open & ~tail
            bad[doc[gap_bad]] = True
            run_of = np.full(len(at), _NONE)
            run_of[run_token[within]] = np.flatnonzero(within)
            self.run_of = run_of
            named = np.flatnonzero(key & (run_of >= 0) & (then == _COLON))
            bad[doc[named[~whole_string[run_of[named]]]]] = True
            named = named[~bad[doc[named]]]
        else:
            self.run_of = np.zeros(0, np.int64)
            named = np.zeros(0, np.int64)
        self.at, self.sign, self.doc, self.inside, self.first, self.has = at, sign, doc, inside, first, has
        self.ok = ~bad & (sizes > 0)
        self.run_doc = run_doc
        self.value_depth = np.where(within, after[np.maximum(run_token, 0)] if len(at) else 0, 0)
        colons = named + 1  # the colon after a key
        self.colon = colons
        self.key_begin, self.key_end = self.run_begin[self.run_of[named]] + 1, self.run_end[self.run_of[named]] - 1
        count = np.concatenate([[0], np.cumsum(slashes)]) if slashes.any() else None
        self.key_escaped = count[self.key_end] > count[self.key_begin] if count is not None else np.zeros(len(colons), dtype=bool)
        self.colon_number = np.full(len(at), _NONE)
        self.colon_number[colons] = np.arange(len(colons))

    def depths(self) -> np.ndarray:
        """rawjson.depth_of each text."""
        out = np.zeros(len(self.texts), np.int64)
        np.maximum.at(out, self.run_doc, self.value_depth)
        opens = (self.sign == _OBJECT) | (self.sign == _ARRAY)
        np.maximum.at(out, self.doc[opens], self.depth[opens] - 1)
        return out

    def root(self) -> Values:
        docs = np.flatnonzero(self.ok)
        container = self.has[docs]
        token = np.where(container, self.first[docs], _NONE)
        run = np.full(len(self.texts), _NONE)
        run[self.run_doc[::-1]] = np.arange(len(self.run_doc))[::-1]
        return self._values(docs, token, run[docs])

    def _values(self, docs, token, run) -> Values:
        held = token >= 0
        begin, end = np.empty(len(docs), np.int64), np.empty(len(docs), np.int64)
        begin[held], end[held] = self.at[token[held]], self.at[self.close[token[held]]] + 1
        begin[~held], end[~held] = self.run_begin[run[~held]], self.run_end[run[~held]]
        return Values(docs, token, begin, end)

    def after(self, docs: np.ndarray, token: np.ndarray) -> Values:
        """The values that follow colons, commas of arrays or opening brackets of arrays that are not empty."""
        run = self.run_of[token]
        return self._values(docs, np.where(run >= 0, _NONE, token + 1), run)

    def named(self, key: bytes) -> np.ndarray:
        """Colons whose key, without escapes, is this one."""
        at = np.flatnonzero(self.key_end - self.key_begin == len(key))
        for k, byte in enumerate(key):
            at = at[self.data[self.key_begin[at] + k] == byte]
        return at

    def members(self, objects: Values, key: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of some objects, each of a text of its own: which have the key, the number of its first colon, and which have keys with escapes."""
        owner = np.full(len(self.at), _NONE)
        owner[objects.token] = np.arange(len(objects.docs))
        mine = owner[self.inside[self.colon]]
        odd = np.zeros(len(objects.docs), dtype=bool)
        odd[mine[self.key_escaped & (mine >= 0)]] = True
        hit = self.named(key)
        hit = hit[(mine[hit] >= 0)]
        who, at = np.unique(mine[hit], return_index=True)
        return who, hit[at], odd

    def find(self, steps) -> Values:
        """The values at a path, of the texts that have one and are plain enough; others are left out."""
        found = self.root()
        for step in steps:
            found = self.step(found, step)
        return found

    def step(self, found: Values, step) -> Values:
        kind = _ARRAY if isinstance(step, int) else _OBJECT
        found = found.where((found.token >= 0) & (self.sign[np.maximum(found.token, 0)] == kind)) if len(self.at) else found.where(np.zeros(len(found.docs), dtype=bool))
        if isinstance(step, str):
            who, colon, odd = self.members(found, step.encode())
            fine = ~odd[who]
            return self.after(found.docs[who[fine]], self.colon[colon[fine]])
        if not len(found.docs):
            return found
        place = self.place[found.token] + step
        token = self.order[np.minimum(place, len(self.order) - 1)]
        there = (place < len(self.order)) & (self.inside[token] == found.token) & (token != self.close[found.token])
        there &= (self.run_of[token] >= 0) | (token + 1 != self.close[found.token])  # an empty array
        return self.after(found.docs[there], token[there])


class Values:
    """A value of each of some texts: token that opens it (or none), where it begins and ends in the batch's data."""

    def __init__(self, docs, token, begin, end):
        self.docs, self.token, self.begin, self.end = docs, token, begin, end

    def where(self, mask) -> Values:
        return Values(self.docs[mask], self.token[mask], self.begin[mask], self.end[mask])


def _spliced(b: Batch, out: list, docs, begin, end, value) -> None:
    """out: the texts with value in place of what lies from begin to end."""
    value_of = value if isinstance(value, list) else None
    for k, (d, s, e) in enumerate(zip(docs.tolist(), (begin - b.begin[docs]).tolist(), (end - b.begin[docs]).tolist())):
        text = b.texts[d]
        out[d] = text[:s] + (value_of[k] if value_of else value) + text[e:]


def _object_at(b: Batch, steps) -> Values:
    found = b.find(steps)
    return found.where((found.token >= 0) & (b.sign[np.maximum(found.token, 0)] == _OBJECT)) if len(b.at) else found.where(np.zeros(len(found.docs), dtype=bool))


def set_value(texts: list[bytes], op: dict) -> list:
    b, out = Batch(texts), [None] * len(texts)
    found = b.find(op["path"])
    _spliced(b, out, found.docs, found.begin, found.end, op["value"].encode())
    return out


def upsert_key(texts: list[bytes], steps, key: str, value: str | list[str]) -> list:
    """edit.upsert_key of each text; None where that is left to the function for single texts."""
    b, out = Batch(texts), [None] * len(texts)
    objects = _object_at(b, steps)
    who, colon, odd = b.members(objects, key.encode())
    own = b.after(objects.docs[who], b.colon[colon])
    fine = ~odd[who]
    _spliced(b, out, own.docs[fine], own.begin[fine], own.end[fine], value.encode())
    lacks = ~odd
    lacks[who] = False
    rest = objects.where(lacks)
    full = b.run_of[rest.token] >= 0
    pair = f"{J.key_token(key)}:{value}".encode()
    for mask, text in ((full, b"," + pair), (~full, pair)):
        _spliced(b, out, rest.docs[mask], rest.end[mask] - 1, rest.end[mask] - 1, text)
    return out


def upsert(texts: list[bytes], op: dict) -> list:
    *parents, last = op["path"] or (0,)
    if not isinstance(last, str):
        return [None] * len(texts)
    return upsert_key(texts, parents, last, op["value"])


def delete_key(texts: list[bytes], steps, key: str, missing: bool = False) -> list:
    """edit.delete_key of each text; where the key is missing None, or with `missing` the text as it is."""
    b, out = Batch(texts), [None] * len(texts)
    objects = _object_at(b, steps)
    who, colon, odd = b.members(objects, key.encode())
    if missing:
        lacks = ~odd
        lacks[who] = False
        for d in objects.docs[lacks].tolist():
            out[d] = texts[d]
    fine = ~odd[who]
    who, colon = who[fine], colon[fine]
    if not len(who):
        return out
    token, opener = b.colon[colon], objects.token[who]
    place = b.place[token]
    first = b.order[place - 1] == opener
    then = b.order[place + 1]  # a comma, or the end of the object
    last = b.sign[then] == _OBJECT_END
    begin = np.where(first, b.at[opener] + 1, b.key_begin[colon] - 1)
    end = b.at[then]
    more = np.flatnonzero(~last)
    end = end.copy()
    end[more] = b.key_begin[b.colon_number[b.order[place[more] + 2]]] - 1
    ending = np.flatnonzero(last & ~first)
    if len(ending):
        before = b.order[place[ending] - 2]  # the colon of the member before
        begin[ending] = b.after(objects.docs[who[ending]], before).end
    _spliced(b, out, objects.docs[who], begin, end, b"")
    return out


def delete(texts: list[bytes], op: dict) -> list:
    *parents, last = op["path"] or (0,)
    return (delete_key if isinstance(last, str) else delete_index)(texts, tuple(parents), last) if op["path"] else [None] * len(texts)


def append(texts: list[bytes], op: dict) -> list:
    b, out = Batch(texts), [None] * len(texts)
    found = b.find(op["path"])
    if len(b.at):
        found = found.where((found.token >= 0) & (b.sign[np.maximum(found.token, 0)] == _ARRAY))
        full = (b.run_of[found.token] >= 0) | (found.token + 1 != b.close[found.token])
        for mask, text in ((full, "," + op["value"]), (~full, op["value"])):
            _spliced(b, out, found.docs[mask], found.end[mask] - 1, found.end[mask] - 1, text.encode())
    return out


def _by_doc(found: Values, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the value of each of n texts begins and ends; -1 for those without."""
    begin, end = np.full(n, _NONE), np.full(n, _NONE)
    begin[found.docs], end[found.docs] = found.begin, found.end
    return begin, end


def insert(texts: list[bytes], steps, index: int, value: str) -> list:
    """edit.insert of each text; a place past the end is left to single texts."""
    b, out = Batch(texts), [None] * len(texts)
    there = b.find((*steps, index))
    _spliced(b, out, there.docs, there.begin, there.begin, f"{value},".encode())
    arrays = b.find(steps)
    if len(b.at):
        arrays = arrays.where((arrays.token >= 0) & (b.sign[np.maximum(arrays.token, 0)] == _ARRAY))
        if index:
            last = np.zeros(len(texts), dtype=bool)
            last[b.find((*steps, index - 1)).docs] = True
        else:
            last = np.ones(len(texts), dtype=bool)
        last[there.docs] = False
        ends = arrays.where(last[arrays.docs])
        _spliced(b, out, ends.docs, ends.end - 1, ends.end - 1, f"{',' if index else ''}{value}".encode())
    return out


def delete_index(texts: list[bytes], steps, index: int) -> list:
    """edit.delete_index of each text."""
    b, out, n = Batch(texts), [None] * len(texts), len(texts)
    own = b.find((*steps, index))
    array_begin, array_end = _by_doc(b.find(steps), n)
    then, _ = _by_doc(b.find((*steps, index + 1)), n)
    _, before = _by_doc(b.find((*steps, index - 1)), n) if index else (None, np.full(n, _NONE))
    d = own.docs
    more = then[d] >= 0
    begin = np.where(index == 0, array_begin[d] + 1, np.where(more, own.begin, before[d]))
    _spliced(b, out, d, begin, np.where(more, then[d], array_end[d] - 1), b"")
    return out


def rename(texts: list[bytes], steps, old: str, new: str, taken: bool = True, missing: bool = False) -> list:
    """edit.rename of each text; a taken name, looked for if asked, and a missing one, but with `missing`, are left to single texts."""
    b, out = Batch(texts), [None] * len(texts)
    objects = _object_at(b, steps)
    who, colon, odd = b.members(objects, old.encode())
    if missing:
        lacks = ~odd
        lacks[who] = False
        for d in objects.docs[lacks].tolist():
            out[d] = texts[d]
    fine = ~odd[who]
    if taken:
        have = np.zeros(len(objects.docs), dtype=bool)
        have[b.members(objects, new.encode())[0]] = True
        fine &= ~have[who]
    who, colon = who[fine], colon[fine]
    if old == new:
        for d in objects.docs[who].tolist():
            out[d] = texts[d]
        return out
    _spliced(b, out, objects.docs[who], b.key_begin[colon] - 1, b.key_end[colon] + 1, J.key_token(new).encode())
    return out


def _then(texts: list, function) -> list:
    """function of those texts that are not None."""
    at = [i for i, t in enumerate(texts) if t is not None]
    out: list = [None] * len(texts)
    if at:
        for i, t in zip(at, function([texts[i] for i in at])):
            out[i] = t
    return out


def merge_patch(texts: list[bytes], steps: tuple, patch: str) -> list:
    """edit.merge_patch of each text, for a patch that is an object; targets that are none are left to single texts."""
    from docweave.functions.edit import _patched

    patch = patch.strip()
    if J.kind_of(patch) != "object":
        return [None] * len(texts)
    b = Batch(texts)
    out: list = [None] * len(texts)
    for d in _object_at(b, steps).docs.tolist():
        out[d] = texts[d]
    for token, value in J.members(patch):
        key = J.unquoted(token)
        if value == "null":
            out = _then(out, lambda t: delete_key(t, steps, key, missing=True))
        elif J.kind_of(value) == "object":
            out = _then(out, lambda t: _merged(t, steps, key, value, _patched("null", value)))
        else:
            out = _then(out, lambda t: upsert_key(t, steps, key, value))
    return out


def _merged(texts: list[bytes], steps: tuple, key: str, patch: str, whole: str) -> list:
    """Texts whose member of this key is merged with an object, or becomes what that gives by itself."""
    b = Batch(texts)
    inner = set(_object_at(b, (*steps, key)).docs.tolist())
    has, rest = [t if i in inner else None for i, t in enumerate(texts)], [None if i in inner else t for i, t in enumerate(texts)]
    made = _then(has, lambda t: merge_patch(t, (*steps, key), patch))
    other = _then(rest, lambda t: upsert_key(t, steps, key, whole))
    return [a if a is not None else c for a, c in zip(made, other)]


def merge_shallow(texts: list[bytes], op: dict) -> list:
    patch = op["value"].strip()
    if J.kind_of(patch) != "object":
        return [None] * len(texts)
    out: list = list(texts)
    for token, value in J.members(patch):
        out = _then(out, lambda t: upsert_key(t, op["path"], J.unquoted(token), value))
    return out


#: Edits that are provided for many texts at once.
EDITS = {
    "set": set_value,
    "upsert": upsert,
    "delete": delete,
    "append": append,
    "prepend": lambda t, o: insert(t, o["path"], 0, o["value"]),
    "insert": lambda t, o: insert(t, o["path"], o["index"], o["value"]),
    "rename": lambda t, o: rename(t, o["path"], o["old"], o["new"]),
    "merge_shallow": merge_shallow,
    "merge_patch": lambda t, o: merge_patch(t, o["path"], o["value"]),
}


def edited(texts: list[bytes], ops) -> list:
    """Texts after a list of edits; None where one of them is left to single texts."""
    if any(o["op"] not in EDITS for o in ops):
        return [None] * len(texts)
    out: list = list(texts)
    for o in ops:
        out = _then(out, lambda t: EDITS[o["op"]](t, o))
    return out


def transformed(texts: list[bytes], steps, style) -> list:
    """Texts after the steps of a transform pipeline; None where one of them is left to single texts."""
    out: list = [t.strip(b" \t\n\r") for t in texts]
    for name, *args in steps:
        if name == "keep" and style == "compact" and isinstance(args[0], K.Members) and plain(args[0]):
            out = _then(out, lambda t: kept(args[0], t))
        elif name == "rename":
            out = _then(out, lambda t: rename(t, (), *args, taken=False, missing=True))
        elif name == "drop":
            out = _then(out, lambda t: delete_key(t, (), args[0], missing=True))
        elif name == "inject":
            out = _then(out, lambda t: delete_key(t, (), args[0], missing=True))
            out = _then(out, lambda t: upsert_key(t, (), *args))
        else:
            return [None] * len(texts)
    return out


def values(texts: list[bytes], steps) -> list:
    """The text of the value at a path of each text; None where that is left to single texts."""
    b, out = Batch(texts), [None] * len(texts)
    found = b.find(steps)
    for d, s, e in zip(found.docs.tolist(), found.begin.tolist(), found.end.tolist()):
        out[d] = b.raw[s:e]
    return out


def lengths(texts: list[bytes], paths) -> list:
    """Bytes of the values at some paths together."""
    b = Batch(texts)
    total, met = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for steps in paths:
        found = b.find(steps)
        total[found.docs] += found.end - found.begin
        met[found.docs] += 1
    return [t if m == len(paths) else None for t, m in zip(total.tolist(), met.tolist())]


def depths(texts: list[bytes]) -> list:
    b = Batch(texts)
    return [d if ok else None for d, ok in zip(b.depths().tolist(), b.ok.tolist())]


def projected(texts: list[bytes], path, steps) -> list:
    """The list that path[*] and the keys after it give, as text, without nulls; None where that is left to single texts."""
    b, out = Batch(texts), [None] * len(texts)
    arrays = b.find(path)
    if not len(b.at):
        return out
    arrays = arrays.where((arrays.token >= 0) & (b.sign[np.maximum(arrays.token, 0)] == _ARRAY))
    full = (b.run_of[arrays.token] >= 0) | (arrays.token + 1 != b.close[arrays.token])
    wanted = np.zeros(len(b.at), dtype=bool)
    wanted[arrays.token[full]] = True
    token = np.flatnonzero(wanted[b.inside] & ((b.sign == _COMMA) | wanted))
    found = b.after(b.doc[token], token)
    left_out: set[int] = set()
    for key in steps:
        found = found.where((found.token >= 0) & (b.sign[np.maximum(found.token, 0)] == _OBJECT))
        who, colon, odd = b.members(found, key.encode())
        left_out.update(found.docs[odd].tolist())
        found = b.after(found.docs[who], b.colon[colon])
    pieces: dict[int, list[bytes]] = {d: [] for d in arrays.docs.tolist()}
    for d, s, e in zip(found.docs.tolist(), found.begin.tolist(), found.end.tolist()):
        text = b.raw[s:e]
        if text != b"null":
            pieces[d].append(text)
    for d, own in pieces.items():
        if d not in left_out:
            out[d] = b"[" + b",".join(own) + b"]"
    return out


def chunked(texts: list[bytes], function, most: int = 1 << 16) -> list:
    """function of the texts, about `most` bytes at a time."""
    out: list = []
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most or i == len(texts) - 1:
            out += function(texts[at : i + 1])
            at, size = i + 1, 0
    return out


def plain(tree: K.Keep) -> bool:
    """Whether a keep list is of keys alone."""
    return isinstance(tree, K.Whole) or isinstance(tree, K.Members) and all(plain(t) for _, t in tree.fields)


def kept(tree: K.Members, texts: list[bytes]) -> list:
    """keeping.kept of each text in compact style; None where that is left to the function for single texts."""
    b, out = Batch(texts), [None] * len(texts)
    roots = b.root()
    left_out: set[int] = set()
    made = _kept(b, tree, roots.docs, roots, left_out)
    for d, text in zip(roots.docs.tolist(), made):
        if d not in left_out:
            out[d] = text
    return out


def _kept(b: Batch, tree: K.Keep, docs, values: Values, left_out: set[int]) -> list[bytes]:
    """What is kept of each value."""
    if isinstance(tree, K.Whole):
        return [b.raw[s:e] for s, e in zip(values.begin.tolist(), values.end.tolist())]
    is_object = (values.token >= 0) & (b.sign[np.maximum(values.token, 0)] == _OBJECT) if len(b.at) else np.zeros(len(values.docs), dtype=bool)
    pieces: list[list] = [[] for _ in values.docs]
    if is_object.any():
        owner = np.full(len(b.at), _NONE)
        owner[values.token[is_object]] = np.flatnonzero(is_object)
        mine = owner[b.inside[b.colon]]
        left_out.update(values.docs[mine[b.key_escaped & (mine >= 0)]].tolist())
        for key, child in tree.fields:
            hit = b.named(key.encode())
            hit = hit[mine[hit] >= 0]
            who = mine[hit]
            own = b.after(values.docs[who], b.colon[hit])
            for w, at, s, e, text in zip(who.tolist(), hit.tolist(), b.key_begin[hit].tolist(), b.key_end[hit].tolist(), _kept(b, child, own.docs, own, left_out)):
                pieces[w].append((at, b.raw[s - 1 : e + 1] + b":" + text))
    return [b"{" + b",".join(t for _, t in sorted(own)) + b"}" if obj else b"null" for own, obj in zip(pieces, is_object.tolist())]


def element_spans(texts: list[bytes], steps) -> list:
    """(begin, end), in bytes, of each element of the array at a path of each text; None where that is left to single texts."""
    b, out = Batch(texts), [None] * len(texts)
    if not len(b.at):
        return out
    arrays = b.find(steps)
    arrays = arrays.where((arrays.token >= 0) & (b.sign[np.maximum(arrays.token, 0)] == _ARRAY))
    full = (b.run_of[arrays.token] >= 0) | (arrays.token + 1 != b.close[arrays.token])
    wanted = np.zeros(len(b.at), dtype=bool)
    wanted[arrays.token[full]] = True
    token = np.flatnonzero(wanted[b.inside] & ((b.sign == _COMMA) | wanted))
    found = b.after(b.doc[token], token)
    for d in arrays.docs.tolist():
        out[d] = []
    for d, s, e in zip(found.docs.tolist(), (found.begin - b.begin[found.docs]).tolist(), (found.end - b.begin[found.docs]).tolist()):
        out[d].append((s, e))
    return out


def member_spans(texts: list[bytes], steps) -> list:
    """(key, begin, end), in bytes, of each member of the object at a path of each text; None where that is left to single texts."""
    b, out = Batch(texts), [None] * len(texts)
    objects = _object_at(b, steps)
    for d in objects.docs.tolist():
        out[d] = []
    if not len(b.colon):
        return out
    owner = np.zeros(len(b.at), dtype=bool)
    owner[objects.token] = True
    mine = np.flatnonzero(owner[b.inside[b.colon]])
    docs = b.doc[b.colon[mine]]
    found = b.after(docs, b.colon[mine])
    for d, s, e, ks, ke, odd in zip(docs.tolist(), (found.begin - b.begin[docs]).tolist(), (found.end - b.begin[docs]).tolist(), b.key_begin[mine].tolist(), b.key_end[mine].tolist(), b.key_escaped[mine].tolist()):
        out[d].append((J.unquoted(b.raw[ks - 1 : ke + 1].decode()) if odd else b.raw[ks:ke].decode(), s, e))
    return out
