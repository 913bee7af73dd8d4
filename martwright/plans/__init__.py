"""The operators wired into named queries and views."""
