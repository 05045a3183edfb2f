"""From a question to a plan: routing, templates, validation and context."""
