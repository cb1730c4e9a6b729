"""Quality of the library."""
