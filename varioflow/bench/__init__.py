"""Registered queries, their SQL, and the traces that both are run on."""
