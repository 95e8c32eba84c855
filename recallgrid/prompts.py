"""Prompt templates on the driver, and chats rendered as columns."""

from __future__ import annotations

import re
from string import Template

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_template(text: str, names: dict | None = None, values: dict | None = None) -> str:
    """``{x}`` of a format string as ``${x}``, renamed by ``names``, or replaced by ``values``."""
    names, values = names or {}, values or {}
    return re.sub(r"\{(\w+)\}", lambda m: str(values[m[1]]) if m[1] in values else "${" + names.get(m[1], m[1]) + "}", text)


class Prompts:
    """Named chats: lists of (role, template)."""

    def __init__(self, chats: dict[str, list[tuple[str, str]]] | None = None):
        self.chats = dict(chats or {})

    def add(self, name: str, chat: list[tuple[str, str]]) -> None:
        self.chats[name] = chat

    def names(self) -> list[str]:
        return sorted(self.chats)

    def valid(self, name: str) -> bool:
        return all(role in ("system", "user", "assistant") and isinstance(t, str) for role, t in self.chats.get(name, [("", "")]))

    def render(self, name: str, **values: str) -> list[dict]:
        """The chat with every placeholder filled; a missing one is a ``KeyError``."""
        return [{"role": role, "content": Template(t).substitute(values)} for role, t in self.chats[name]]

    def column(self, name: str, **values: Column) -> Column:
        """An array of (role, content) with the placeholders filled from columns; null where a value is null."""

        def filled(t: str) -> Column:
            parts, at = [], 0
            for m in Template.pattern.finditer(t):
                key = m["named"] or m["braced"]
                parts += [F.lit(t[at : m.start()]), F.lit("$") if m["escaped"] is not None else values[key].cast("string")]
                at = m.end()
            return F.concat(*parts, F.lit(t[at:]))

        return F.array(*(F.struct(F.lit(role).alias("role"), filled(t).alias("content")) for role, t in self.chats[name]))


def chat_text(chat: Column, form: str = "<|{role}|>\n{content}\n", last: str = "<|assistant|>\n") -> Column:
    """A chat (role, content) as one model input."""
    before, middle, after = re.fullmatch(r"(.*)\{role\}(.*)\{content\}(.*)", form, re.S).groups()
    return F.concat(F.array_join(F.transform(chat, lambda m: F.concat(F.lit(before), m["role"], F.lit(middle), m["content"], F.lit(after))), ""), F.lit(last))
