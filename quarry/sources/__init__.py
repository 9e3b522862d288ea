"""Tables and derived frames."""
