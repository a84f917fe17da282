"""Registered queries: operators applied to the supplied tables, with check SQL."""
