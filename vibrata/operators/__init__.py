"""DataFrame-to-DataFrame operators over signals, windows and feature tables."""
