"""Whole results: reports, cross-references, samples, status, exports."""
