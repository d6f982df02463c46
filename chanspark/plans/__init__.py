"""How a channel group is cut into partitions."""
