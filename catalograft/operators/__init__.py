"""DataFrame operators: links, products, discovery, merges and queues."""
