"""What an operator of a pipeline is: a token with a contract on the state, and a step that plans its columns."""

from __future__ import annotations

from ..plans.state import Port, State


class Token:
    """Subclass it for an operator of your own: name the contract, and plan columns in apply."""

    name = ""
    kind = "feature"
    reads: tuple[str, ...] = ()
    requires: tuple[Port, ...] = ()
    provides: tuple[Port, ...] = ()
    max_uses: int | None = None
    class_max_uses: int | None = None
    learning_scope = "n/a"

    def can_apply(self, state: State) -> bool:
        if self.class_max_uses is not None and state.classes.count(self.kind) >= self.class_max_uses:
            return False
        if self.max_uses is not None and state.sequence.count(self.name) >= self.max_uses:
            return False
        if not all(state.has(r) for r in self.reads):
            return False
        return all(p.optional or self._port(state, p) for p in self.requires) and self.ready(state)

    def _port(self, state: State, port: Port) -> bool:
        if any(port.matches(s, state.space) for s in state.board):
            return True
        return port.coerce and port.sem == "features" and bool(state.bundle())

    def ready(self, state: State) -> bool:
        return True

    def apply(self, state: State) -> State:
        raise NotImplementedError

    def run(self, state: State) -> State:
        """apply, and a line in the log."""
        if not self.can_apply(state):
            raise RuntimeError(f"{self.name} can't be applied after {' -> '.join(state.sequence) or 'the start'}")
        after = self.apply(state)
        old = {s.name for s in state.board}
        return after.record(self.name, self.kind, list(self.reads), sorted(s.name for s in after.board if s.name not in old))


class BeforeModels(Token):
    """Cleaning and transform tokens: none may run after a model."""

    def can_apply(self, state: State) -> bool:
        return not state.predictions and super().can_apply(state)


class CleaningToken(BeforeModels):
    kind = "cleaning"


class TransformToken(BeforeModels):
    kind = "transform"


class FeatureToken(Token):
    kind = "feature"


class ModelToken(Token):
    """Needs a historical feature on the board."""

    kind = "model"

    def can_apply(self, state: State) -> bool:
        return bool(state.features) and super().can_apply(state)


class ControlToken(Token):
    kind = "control"


class Stop(ControlToken):
    """Ends a pipeline that has a prediction: the forecast is decoded into final_forecast."""

    name = "STOP"

    def ready(self, state: State) -> bool:
        return bool(state.predictions)

    def apply(self, state: State) -> State:
        return state.note(("terminated",)).emit(df=state.df.withColumn("final_forecast", state.decoded()))
