"""The versioned edge store."""
