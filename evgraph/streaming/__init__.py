"""evgraph.streaming"""
