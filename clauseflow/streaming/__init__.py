"""The stateless stages on streams."""
