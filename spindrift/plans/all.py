"""Imports every module that registers queries."""

from spindrift.plans import array_plans, batch_plans, group_plans, loss_plans, math_plans, metric_plans, plugin_plans, policy_plans, prompt_plans, record_plans, reward_plans, shape_plans, state_plans, text_plans, video_plans  # noqa: F401
from spindrift.plans.registry import ORACLES, QUERIES  # noqa: F401
