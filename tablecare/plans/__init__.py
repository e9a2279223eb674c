"""Multi-step plans: the registry of rules and repairs, the repair loop and the full run."""
