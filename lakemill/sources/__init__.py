"""Tables, landing files and control tables."""
