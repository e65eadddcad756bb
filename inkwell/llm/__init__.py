"""Training-data operators over document tables; nothing outside imports this subpackage."""
