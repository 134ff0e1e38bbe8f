"""Floating-point operations of a training step, from a model's shape."""

from __future__ import annotations

#: Peak operations a second by a part of the device's name, the first that fits.
PEAKS = [("MI300X", 1336e12), ("H100", 989e12), ("H800", 989e12), ("H200", 989e12), ("A100", 312e12), ("A800", 312e12), ("L40", 181.05e12), ("L20", 119.5e12), ("H20", 148e12), ("910B", 354e12), ("RTX 3070 Ti", 21.75e12)]
#: Families by the layout of their layers.
FAMILIES = {"qwen2": "dense", "llama": "dense", "qwen2_vl": "dense", "qwen2_5_vl": "dense", "qwen3": "dense", "qwen3_moe": "experts", "deepseek_v3": "latent"}


def peak(device: str) -> float:
    """Peak operations a second; infinite for an unknown device, so that its share is 0."""
    return next((flops for part, flops in PEAKS if part in device), float("inf"))


def costs(config: dict) -> tuple[int, int]:
    """(operations per token, per squared length of a sequence), forward and backward; zeros for an unknown family."""
    kind = FAMILIES.get(config["model_type"])
    if kind is None:
        return 0, 0
    h, layers = config["hidden_size"], config["num_hidden_layers"]
    ends = 2 * config["vocab_size"] * h
    if kind == "latent":
        heads, rank = config["num_attention_heads"], config["kv_lora_rank"]
        nope, rope, value = config["qk_nope_head_dim"], config["qk_rope_head_dim"], config["v_head_dim"]
        narrow = config.get("q_lora_rank")
        query = (h + heads * (nope + rope)) * narrow if narrow else h * heads * (nope + rope)
        attention = query + h * (rank + rope) + heads * (nope + value) * rank + heads * value * h
        first = config["first_k_dense_replace"]
        routed = h * config["n_routed_experts"] + 3 * h * config["moe_intermediate_size"] * (config["num_experts_per_tok"] + config["n_shared_experts"])
        weights = layers * attention + (layers - first) * routed + first * 3 * h * config["intermediate_size"] + ends
        return 6 * weights, 12 * (nope + rope) * heads * layers
    heads, shared = config["num_attention_heads"], config["num_key_value_heads"]
    size = config.get("head_dim") or h // heads
    if kind == "dense":
        inner = 3 * h * config["intermediate_size"]
    else:
        inner = 3 * h * config["moe_intermediate_size"] * config["num_experts_per_tok"] + h * config["num_experts"]
    return 6 * (layers * (inner + 2 * h * size * (heads + shared)) + ends), 12 * size * heads * layers
