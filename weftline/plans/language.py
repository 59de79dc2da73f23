"""The pipeline language: `token(key=value, ...) -> token -> STOP`."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..operators.base import Stop, Token
from .grammar import START, STOP, Grammar
from .state import State


class PipelineSyntaxError(ValueError):
    pass


class PipelineValidationError(ValueError):
    pass


@dataclass(frozen=True)
class TokenCall:
    name: str
    kwargs: tuple[tuple[str, object], ...] = ()

    def to_source(self) -> str:
        return self.name + (f"({', '.join(f'{k}={literal(v)}' for k, v in self.kwargs)})" if self.kwargs else "")


@dataclass(frozen=True)
class Pipeline:
    steps: tuple[TokenCall, ...]
    stop: bool = False

    @property
    def names(self) -> list[str]:
        return [s.name for s in self.steps]

    def to_source(self) -> str:
        return " -> ".join([s.to_source() for s in self.steps] + [STOP] * self.stop)


def literal(value: object) -> str:
    if value is None:
        return "None"
    if isinstance(value, bool):
        return "true" if value else "false"
    return '"' + value.replace("\\", "\\\\").replace('"', '\\"') + '"' if isinstance(value, str) else repr(value)


_LEXEME = re.compile(r"""\s*(?:(?P<arrow>->|=>)|(?P<number>[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<text>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<name>[A-Za-z_]\w*)|(?P<mark>[(),=]))""")
_WORDS = {"true": True, "True": True, "false": False, "False": False, "none": None, "None": None, "null": None}


def parse_pipeline(source: str) -> Pipeline:
    """Recursive descent over the lexemes; raises PipelineSyntaxError."""
    lexemes, at = [], 0
    while source[at:].strip():
        m = _LEXEME.match(source, at)
        if not m:
            raise PipelineSyntaxError(f"unexpected {source[at:].strip()[:20]!r} at {at}")
        lexemes.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    pos = 0

    def take(kind: str, value: str | None = None) -> str:
        nonlocal pos
        if pos >= len(lexemes) or lexemes[pos][0] != kind or value not in (None, lexemes[pos][1]):
            found = lexemes[pos][1] if pos < len(lexemes) else "the end"
            raise PipelineSyntaxError(f"expected {value or kind}, found {found!r}")
        pos += 1
        return lexemes[pos - 1][1]

    def next_is(value: str) -> bool:
        return pos < len(lexemes) and lexemes[pos] == ("mark", value)

    def call() -> TokenCall:
        nonlocal pos
        name, kwargs = take("name"), []
        if next_is("("):
            pos += 1
            while not next_is(")"):
                key = take("name")
                take("mark", "=")
                kind, text = lexemes[pos] if pos < len(lexemes) else ("end", "the end")
                if kind == "number":
                    value: object = float(text) if re.search(r"[.eE]", text) else int(text)
                elif kind == "text":
                    value = re.sub(r"\\(.)", r"\1", text[1:-1])
                elif kind == "name" and text in _WORDS:
                    value = _WORDS[text]
                else:
                    raise PipelineSyntaxError(f"expected a value, found {text!r}")
                pos += 1
                kwargs.append((key, value))
                if not next_is(")"):
                    take("mark", ",")
            pos += 1
        return TokenCall(name, tuple(kwargs))

    steps = [call()]
    while pos < len(lexemes):
        take("arrow")
        steps.append(call())
    stop = steps[-1].name == STOP
    if any(s.name == STOP for s in steps[: len(steps) - stop]) or (stop and (steps[-1].kwargs or len(steps) == 1)):
        raise PipelineSyntaxError("STOP ends a pipeline and takes no arguments")
    return Pipeline(tuple(steps[: len(steps) - stop]), stop)


def validate_pipeline(pipeline: Pipeline | str, grammar: Grammar, state: State | None = None) -> Pipeline:
    """Names and edges, and with a state whether every token can be applied, in turn; raises PipelineValidationError."""
    pipeline = parse_pipeline(pipeline) if isinstance(pipeline, str) else pipeline
    unknown = [n for n in pipeline.names if n not in grammar.tokens]
    if unknown:
        raise PipelineValidationError(f"unknown tokens: {', '.join(dict.fromkeys(unknown))}")
    path = [START, *pipeline.names, *([STOP] if pipeline.stop else [])]
    for a, b in zip(path, path[1:], strict=False):
        if b not in grammar.edges.get(a, ()):
            raise PipelineValidationError(f"{b} can't follow {a}")
    if state is not None:
        walk(pipeline, grammar, state)
    return pipeline


def walk(pipeline: Pipeline, grammar: Grammar, state: State, bind_kwargs: bool = False) -> State:
    for step in pipeline.steps:
        token: Token = grammar.tokens[step.name]
        if step.kwargs:
            if not bind_kwargs:
                raise PipelineValidationError(f"{step.name} takes no arguments here; construct the token with them")
            token = type(token)(**dict(step.kwargs))
        if not token.can_apply(state):
            raise PipelineValidationError(f"{step.name} can't be applied after {' -> '.join(state.sequence) or START}")
        state = token.run(state)
    if pipeline.stop:
        if not Stop().can_apply(state):
            raise PipelineValidationError("STOP needs a model before it")
        state = Stop().run(state)
    return state


def apply_pipeline(pipeline: Pipeline | str, grammar: Grammar, state: State, bind_kwargs: bool = False) -> State:
    """The state after a pipeline: a lazy plan, but for the small looks at data that some tokens take."""
    return walk(validate_pipeline(pipeline, grammar), grammar, state, bind_kwargs)


def run_sequence(names: list[str], grammar: Grammar, state: State) -> list[State]:
    """States after each token, by their contracts alone; edges aren't looked at and STOP isn't needed."""
    out = [state]
    for n in names:
        token = Stop() if n == STOP else grammar.tokens[n]
        if not token.can_apply(out[-1]):
            raise RuntimeError(f"{n} can't be applied after {' -> '.join(out[-1].sequence) or START}")
        out.append(token.run(out[-1]))
    return out
