"""lumencat.operators"""
