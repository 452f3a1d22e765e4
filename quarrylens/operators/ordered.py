"""Tokens that follow one another: a linear matcher over the events of a text.

A text is cut into events, each a token or a barrier with the characters before
it. One fold over the events keeps, for every number of tokens, where the latest
chain of so many tokens ends; the latest is the best one to go on from, as only
the distance to it and the barriers after it count. So a text costs its length
and its events, however often its tokens repeat. The expressions are SQL text: a scan
has hundreds of them, and text is parsed in less time than columns are put together.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: No chain of that length yet.
NONE = -(1 << 60)


def quoted(text: str) -> str:
    """A string literal of Spark SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


@dataclass(frozen=True)
class Sequence:
    """Tokens in order with at most ``gap`` characters between, none of them a barrier or, unless ``across``, a newline.

    Tokens and barriers are found from left to right without overlaps; a token's
    text that several of the patterns match counts for each of them.
    """

    tokens: tuple[str, ...]
    gap: int = 200
    barriers: str = ""
    across: bool = False

    def __post_init__(self) -> None:
        if len(self.tokens) < 2:
            raise ValueError("a sequence has two tokens or more")
        for t in self.tokens:
            if re.compile(t).groups:
                raise ValueError(f"{t}: a token has no capturing group")
            if re.match(t, ""):
                raise ValueError(f"{t}: a token is not empty")

    def possible(self, text: str, flags: str = "") -> str:
        """Whether every token is somewhere in the column ``text``."""
        head = f"(?{flags})" if flags else ""
        return "(" + " AND ".join(f"{text} RLIKE {quoted(head + t)}" for t in dict.fromkeys(self.tokens)) + ")"

    def found(self, text: str, flags: str = "", first_line: bool = False) -> str:
        """Whether the tokens follow one another in the column; with ``first_line`` the first one begins in its first line."""
        head = f"(?{flags})" if flags else ""
        outside = ("" if self.across else r"\n") + self.barriers
        any_token = "|".join(f"(?:{t})" for t in dict.fromkeys(self.tokens))
        pattern = quoted(head + rf"\G([\s\S]*?)(?:({any_token})" + (f"|[{outside}])" if outside else ")"))
        n, nowhere = len(self.tokens), f"{NONE}L"
        # where the first token may begin; carried along, as a fold would compute it at every event
        limit = f"CASE WHEN {text} LIKE '%\\n%' THEN instr({text}, '\\n') - 1 ELSE length({text}) END" if first_line else f"{-NONE}L"
        start = f"named_struct('at', 0L, 'limit', CAST({limit} AS BIGINT), {', '.join(f"'e{k}', {nowhere}" for k in range(1, n))}, 'hit', false)"
        # an empty token is a barrier: one character, which ends all chains
        begin = "(s.at + x.skip)"
        fits = [f"x.token RLIKE {quoted(f'{head}^(?:{t})$')}" for t in self.tokens]
        chain = [f"({begin} < s.limit AND {fits[0]})"] + [f"({begin} - s.e{k} <= {self.gap} AND {fits[k]})" for k in range(1, n)]
        ends = ", ".join(f"'e{k}', CASE WHEN x.token = '' THEN {nowhere} WHEN {chain[k - 1]} THEN {begin} + length(x.token) ELSE s.e{k} END" for k in range(1, n))
        step = f"named_struct('at', {begin} + greatest(length(x.token), 1), 'limit', s.limit, {ends}, 'hit', s.hit OR (x.token <> '' AND {chain[n - 1]}))"
        events = f"zip_with(regexp_extract_all({text}, {pattern}, 1), regexp_extract_all({text}, {pattern}, 2), (b, t) -> named_struct('skip', length(b), 'token', t))"
        return f"(CASE WHEN {self.possible(text, flags)} THEN aggregate({events}, {start}, (s, x) -> {step}, s -> s.hit) ELSE false END)"
