"""Programs: rules and data that can be added to, taken from, queried and explained."""
