"""evgraph.operators"""
