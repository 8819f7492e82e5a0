"""The trainer-side contracts: which dataset each training configuration takes, how much of it, and how it is split."""

from __future__ import annotations

# Configuration -> stage, dataset, cutoff_len, max_samples, val_size.
CONTRACTS = {
    "full_0.6B": ("sft", "reasoning", 8192, 50000, 0.05),
    "full_1.7B": ("sft", "reasoning", 16384, 20000, 0.05),
    "full_4B": ("sft", "reasoning", 4096, 20000, 0.1),
    "full_8B": ("sft", "reasoning", 4096, 20000, 0.05),
    "lora_4B_schema_baseline": ("sft", "schema_sft_baseline", 2048, 2500, 0.1),
    "lora_4B_glaive": ("sft", "glaive_sft", 2048, 20000, 0.1),
    "lora_4B_hermes": ("sft", "hermes_sft", 2048, None, 0.05),
    "rft_8B": ("sft", "rft", 4096, None, 0.05),
    "grpo_8B": ("sft", "rft", 4096, None, 0.05),
    "dpo_0.6B": ("dpo", "dpo", 2048, None, 0.05),
    "dpo_4B_schema_baseline": ("dpo", "schema_dpo_baseline", 1536, 2000, 0.05),
    "dpo_8B": ("dpo", "dpo", 2048, None, 0.05),
}
