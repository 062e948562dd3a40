"""Readers, proxies over the test tables, versioned tables."""
