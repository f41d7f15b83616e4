"""Strict scans, manifests, fingerprints and write-once publishing."""
