"""Column builders: text analysis and scoring arithmetic."""
