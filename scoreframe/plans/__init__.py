"""Multi-stage plans: judges, retrieval metrics, evaluation and reports."""
