"""Building JSON text on the driver: nested builders and a writer that keeps track of where it is. For columns see operators.columns."""

from __future__ import annotations

from docweave.errors import InvalidSyntax
from docweave.functions.edit import encoded, one_value
from docweave.functions.rawjson import key_token


class ArrayBuilder:
    def __init__(self):
        self.parts: list[str] = []

    def item(self, value) -> ArrayBuilder:
        self.parts.append(encoded(value))
        return self

    def raw_item(self, text: str) -> ArrayBuilder:
        self.parts.append(one_value(text))
        return self

    def null_item(self) -> ArrayBuilder:
        return self.item(None)

    def item_opt(self, value) -> ArrayBuilder:
        """None adds nothing."""
        return self if value is None else self.item(value)

    def object(self, build) -> ArrayBuilder:
        self.parts.append(build(ObjectBuilder()).finish())
        return self

    def array(self, build) -> ArrayBuilder:
        self.parts.append(build(ArrayBuilder()).finish())
        return self

    def extend(self, values) -> ArrayBuilder:
        for v in values:
            self.item(v)
        return self

    def __len__(self) -> int:
        return len(self.parts)

    def finish(self) -> str:
        return "[" + ",".join(self.parts) + "]"


class ObjectBuilder:
    def __init__(self):
        self.parts: list[str] = []

    def raw_field(self, key: str, text: str) -> ObjectBuilder:
        self.parts.append(f"{key_token(key)}:{one_value(text)}")
        return self

    def field(self, key: str, value) -> ObjectBuilder:
        return self.raw_field(key, encoded(value))

    def null_field(self, key: str) -> ObjectBuilder:
        return self.field(key, None)

    def field_opt(self, key: str, value) -> ObjectBuilder:
        """None adds nothing."""
        return self if value is None else self.field(key, value)

    def field_if(self, condition: bool, key: str, value) -> ObjectBuilder:
        return self.field(key, value) if condition else self

    def object_field(self, key: str, build) -> ObjectBuilder:
        return self.raw_field(key, build(ObjectBuilder()).finish())

    def array_field(self, key: str, build) -> ObjectBuilder:
        return self.raw_field(key, build(ArrayBuilder()).finish())

    def __len__(self) -> int:
        return len(self.parts)

    def finish(self) -> str:
        return "{" + ",".join(self.parts) + "}"


def object_from(fields) -> str:
    out = ObjectBuilder()
    for k, v in fields:
        out.field(k, v)
    return out.finish()


def array_from(items) -> str:
    return ArrayBuilder().extend(items).finish()


class JsonWriter:
    """Writes a document piece by piece; what does not fit the place is an error, and finish closes what is open."""

    def __init__(self, indent: int | None = None):
        self.out: list[str] = []
        self.open: list[list] = []  # bracket, members so far, a key waits for its value
        self.indent, self.done = indent, False

    @property
    def depth(self) -> int:
        return len(self.open)

    def _line(self) -> None:
        if self.indent is not None:
            self.out.append("\n" + " " * self.indent * self.depth)

    def _next(self) -> None:
        if self.open[-1][1]:
            self.out.append(",")
        self.open[-1][1] += 1
        self._line()

    def _place(self) -> None:
        if not self.open:
            if self.done:
                raise InvalidSyntax("a second root value")
            self.done = True
        elif self.open[-1][0] == "[":
            self._next()
        elif self.open[-1][2]:
            self.open[-1][2] = False
        else:
            raise InvalidSyntax("a value without a key")

    def key(self, key: str) -> JsonWriter:
        if not self.open or self.open[-1][0] != "{" or self.open[-1][2]:
            raise InvalidSyntax("no place for a key")
        self._next()
        self.out.append(key_token(key) + (": " if self.indent is not None else ":"))
        self.open[-1][2] = True
        return self

    def raw_value(self, text: str) -> JsonWriter:
        text = one_value(text)
        self._place()
        self.out.append(text)
        return self

    def value(self, value) -> JsonWriter:
        return self.raw_value(encoded(value))

    def null(self) -> JsonWriter:
        return self.value(None)

    def field(self, key: str, value) -> JsonWriter:
        return self.key(key).value(value)

    def raw_field(self, key: str, text: str) -> JsonWriter:
        return self.key(key).raw_value(text)

    def null_field(self, key: str) -> JsonWriter:
        return self.field(key, None)

    def field_opt(self, key: str, value) -> JsonWriter:
        return self if value is None else self.field(key, value)

    def _begin(self, bracket: str) -> JsonWriter:
        self._place()
        self.out.append(bracket)
        self.open.append([bracket, 0, False])
        return self

    def begin_object(self) -> JsonWriter:
        return self._begin("{")

    def begin_array(self) -> JsonWriter:
        return self._begin("[")

    def _end(self, bracket: str) -> JsonWriter:
        if not self.open or self.open[-1][0] != bracket or self.open[-1][2]:
            raise InvalidSyntax("nothing to close here")
        _, size, _ = self.open.pop()
        if size:
            self._line()
        self.out.append("}" if bracket == "{" else "]")
        return self

    def end_object(self) -> JsonWriter:
        return self._end("{")

    def end_array(self) -> JsonWriter:
        return self._end("[")

    def finish(self) -> str:
        while self.open:
            self._end(self.open[-1][0])
        if not self.done:
            raise InvalidSyntax("nothing was written")
        return "".join(self.out)
