"""The rule language: syntax trees, the parser and the normal form of rules."""
