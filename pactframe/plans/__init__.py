"""How contracts become expressions."""
