"""A tool class: an answer is worth a share of the truth; one that is no better than the last costs a penalty."""

from __future__ import annotations

from spindrift.operators.plugins import Tool


class Grading(Tool):
    def create(self, truth):
        return {"truth": float(truth), "best": 0.0}

    def execute(self, state: dict, parameters: dict) -> tuple:
        worth = 1.0 - min(1.0, abs(float(parameters["answer"]) - state["truth"]) / state["truth"])
        reward = 0.0 if worth > state["best"] else self.config["penalty"]
        return {**state, "best": worth}, f"worth {worth:.3f}", reward
