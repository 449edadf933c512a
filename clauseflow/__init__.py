"""Contract review at scale: page text to verified findings, as DataFrame-in, DataFrame-out functions."""
