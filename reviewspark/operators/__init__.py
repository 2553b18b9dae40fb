"""Relational operators: graph, splits, metrics, ablation, summaries, audits."""
