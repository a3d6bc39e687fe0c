"""Query plans: policies, whole-table masking, reports."""
