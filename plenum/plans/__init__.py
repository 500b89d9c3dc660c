"""Registered queries; importing the package registers them all."""

from plenum.plans import civic_checks, civic_matches, civic_outcomes, civic_reads, civic_repairs, civic_texts, civic_writes  # noqa: F401
