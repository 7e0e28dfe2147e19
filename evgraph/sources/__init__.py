"""evgraph.sources"""
